import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and wordless texts, ties, repeated rows, a long text, and columns with clashing names."""
    base = " ".join(f"word{i % 97} item{i % 13} thing{i % 31}" for i in range(80))
    near = base.replace("word5 ", "other ", 1)
    rows = [
        (1, base, "en", "s", 5), (2, base, "en", "s", 5), (3, near, None, None, None), (4, "", "en", "s", 0), (5, None, None, "s", None), (6, "!!! ??", "en", "s", 6),
        (7, "only three words", "en", "s", 16), (7, "only three words", "en", "s", 16), (None, "no id here at all, friend", "en", "s", 9), (8, "Ünïcode wörds — 日本語 🙂 and MIT License text", "de", "s", 9),
        (9, "long " * 9000 + "tail", "en", "s", 9), (10, "Released under the MIT License. Apache license too: general PUBLIC license", "en", "s", 1),
    ]
    return spark.createDataFrame([(*r, 1.0, 2, 3, 4, "x", []) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, node long, band long, row long, ids string, bands array<long>")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
