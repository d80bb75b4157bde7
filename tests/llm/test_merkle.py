"""The Merkle manifest against plain recursion and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def brute(nodes):
    """Root, and each node's (siblings, fold) by plain levels."""
    own, level, seen = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, s in enumerate(seen):
            run = runs[s // 3]
            own[k].append((run[: s % 3], run[s % 3 + 1 :]))
        seen, level = [s // 3 for s in seen], [h(*r) for r in runs]
    return (level or [None])[0], own


def climbed(node, path):
    for left, right in path:
        node = h(*left, node, *right)
    return node


def expected(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    whole = [(r, h(*map(text, r))) for r in rows]
    groups = {}
    for r, x in whole:
        groups.setdefault(r[1], []).append((r, x))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        trees[s] = brute([x for _, x in groups[s]])
    root, upper = brute([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper, strict=True):
        for (r, x), path in zip(groups[s], trees[s][1], strict=True):
            t = r[4]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            folded = climbed(h(*map(text, (*r[:4], t))), path + up)
            assert climbed(x, path + up) == root
            out.append((str(r[0]), x, trees[s][0], root, h(*["".join(a + b) for a, b in path + up]), folded, folded == root))
    return sorted(out)


def digests(n):
    return [h(str(i)) for i in range(n)]


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 242, 243, 244, 500, 728, 729])
def test_traversal_emits_every_path(n):
    nodes = digests(n)
    root, want = brute(nodes)
    assert merkle.root_of(nodes, merkle.height(n)) == root
    got = [[(p["left"], p["right"]) for p in path] for path in merkle.paths(nodes, merkle.height(n))]
    assert got == [[("".join(a), "".join(b)) for a, b in path] for path in want]


def test_a_short_last_block_climbs_all_levels():
    node = digests(1)[0]
    root = node
    for _ in range(merkle.LEVELS):
        root = h(root)
    assert merkle.root_of([node], merkle.LEVELS) == root
    assert list(merkle.paths([node], merkle.LEVELS)) == [[{"left": "", "right": ""}] * merkle.LEVELS]


def proofs(docs):
    changed = [merkle.tampered(F.col("text"), F.col("doc_id")) if c == "text" else F.col(c) for c in merkle.FIELDS]
    leaves = docs.select(F.col("source").alias("group"), "doc_id", merkle.leaf(*map(F.col, merkle.FIELDS)).alias("node"), merkle.leaf(*changed).alias("seen"))
    out = merkle.Manifest.of(leaves, ["doc_id"]).proofs()
    folded = merkle.fold(F.col("seen"), F.col("path"))
    return sorted((str(r.doc_id), r.node, r.subroot, r.root, r.p, r.f, r.f == r.root) for r in out.withColumns({"p": merkle.proof(F.col("path")), "f": folded}).collect())


def test_manifest_with_a_hot_group_and_defined_cases(spark, docs):
    """Two tiers: a group over 729 rows; nulls, repeated rows, one leaf groups."""
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    rows += [(i, "hot", "en", i % 7, f"line {i}\nend {i % 5}") for i in range(100, 1700)] + [(5, "hot", "en", 1, "same\n")] * 40
    rows += [(i, None, None, None, f"free {i}\n") for i in range(30)] + [(None, f"s{i}", "de", 1, None) for i in range(11)] + [(3, "ärger", "de", 1, "x\n"), (4, "z", "de", 1, ""), (4, "", "de", 1, "")]
    got = proofs(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert got == expected(rows)
    assert {x[-1] for x in got} == {True, False}


def test_empty_manifest_and_one_row(spark, none, docs):
    assert proofs(none) == []
    assert merkle.Manifest.of(none.select(F.col("source").alias("group"), "doc_id", F.lit("x").alias("node")), ["doc_id"]).root() is None
    one = docs.where("doc_id = 4").select(*merkle.FIELDS)
    assert proofs(one) == expected([tuple(r) for r in one.collect()])


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = merkle.op11_merkle_manifest(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(merkle.SQL).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
