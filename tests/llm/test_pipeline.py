"""Each stage of the pipeline against a plain Python version: rows kept, and their texts."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common as C
from millrace.llm import pieces, quality
from tests.llm.test_exact import brute_classes, brute_hits, brute_replaced

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


def good_texts(spark, docs):
    """What the classifier keeps, by one-shot compression."""
    import zstandard

    model = quality.trained(spark, SF, docs)
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False).compress(raw))

    def good(text):
        raw, x = (text or "").encode(), np.zeros(3)
        if raw:
            g, b, p = size(raw, model["good"]), size(raw, model["bad"]), size(raw, None)
            x[:] = (b - g) / p, (b - g) / len(raw), p / len(raw)
        return (x - model["mean"]) / np.array(model["sd"]) @ np.array(model["w"][:-1]) + model["w"][-1] >= 0

    return good


def rows_of(df):
    return Counter((str(r.doc_id), r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages_against_plain_python(spark, docs):
    import sentencepiece

    benchmark = C.table(spark, SF, "benchmark")
    leak = benchmark.where("length(text) > 80").first().text
    odd = spark.createDataFrame([(9001, f"{leak} and a few more words", "en", "s", 1), (9002, None, None, None, None), (9003, "", "en", "s", 0), (None, f"nobody: {leak}", "en", "s", 1), (None, "nobody: write to a.b@c.org now please", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    first = C.written(C.table(spark, SF, "documents").select(*COLUMNS).union(docs.select(*COLUMNS)).union(odd).withColumn("score", F.lit("x")), "test-first")
    stages = dict(corpus_pipeline.STAGES)

    kept = C.written(stages["quality_classifier"](spark, first, SF), "test-1")
    good = good_texts(spark, first)
    assert rows_of(kept) == Counter({k: n for k, n in rows_of(first).items() if good(k[1])}) and kept.columns == COLUMNS

    # the next stage gets all rows, also those that the classifier let go
    single = C.written(stages["minhash_near_dedup"](spark, first, SF), "test-2")
    rows = [(r.doc_id, r.text) for r in first.collect()]
    root = brute_roots(rows)
    best = {}
    for (i, _), c in zip(rows, root, strict=True):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    where = {(str(i), t or ""): c for (i, t), c in zip(rows, root, strict=True)}
    got = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(where[str(i), t or ""] for i, t in got) == sorted(best)
    assert all((i is None, i or 0) == best[where[str(i), t or ""]] for i, t in got) and single.columns == COLUMNS

    clean = C.written(stages["benchmark_decontamination"](spark, first, SF), "test-3")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    bad = {t for t in {t for _, t in rows} if brute_hits([(0, t)], items)[0][-1]}
    assert bad and rows_of(clean) == Counter({k: n for k, n in rows_of(first).items() if k[1] not in bad}) and clean.columns == COLUMNS

    safe = C.written(stages["pii_surrogates"](spark, first, SF), "test-4")
    text = lambda t: None if t is None else brute_replaced(t)[0]
    want = Counter()
    for (i, t, lang, source, _), n in rows_of(first).items():
        want[i, text(t), lang, source, None if t is None else len(text(t))] += n
    assert rows_of(safe) == want and safe.columns == COLUMNS

    lib = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    out = stages["sentencepiece"](spark, first, SF).collect()
    assert Counter((str(r.doc_id), tuple(r.ids), r.n_tokens) for r in out) == Counter((str(i), tuple(lib.encode(t or "")), len(lib.encode(t or ""))) for i, t in rows) and all(r.round_trip for r in out)


def brute_roots(rows):
    """The class of each row, whatever ids it has: rows are numbered for the brute-force version."""
    return [int(c) for _, c in sorted((int(i), c) for i, c in brute_classes(list(enumerate(t for _, t in rows))))]


def test_run_keeps_no_tables_on_the_way(spark, monkeypatch):
    """After two stages only the last result is left of what they wrote; it is whole."""
    import os

    at = C.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], stages[3], ("count", lambda spark, docs, sf_dir: docs)])
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(at)) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["stage-pii_surrogates"] and out.count() > 0


def test_tables_on_the_way_are_whole_and_unmarked(spark):
    """No marker file: on a local disk each one has the driver start processes, which share its memory for a moment."""
    import os

    out = C.written(spark.range(7), "unmarked")
    at = out.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    names = os.listdir("/" + at.lstrip("/"))
    assert not [n for n in names if "_SUCCESS" in n] and sorted(r.id for r in out.collect()) == list(range(7))
