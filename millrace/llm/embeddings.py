"""Embedding near-dedup by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within eps = sqrt(2 - 2t) of each other. They are
turned onto their leading principal directions, laid in grid cells of side eps, and sorted
by cell, dimension after dimension (their length comes first, so that vectors of
different lengths are provably distant). The sorted sequence is cut into intervals, and
the whole sequence is joined with itself recursively: a pair of stretches whose bounding boxes are
farther apart than eps is dropped, any other is split into FAN parts on either side, down to
intervals. A pair of intervals is halved further inside its task, and small blocks are compared by a
matrix product. What single precision finds near the threshold is decided in double
precision on the vectors as given, scaled by a power of two so that no finite value overflows.

Equal vectors are one node with a count; a node is named by its content, never by an
id. A comparison yields counts and, for each node, the least node that it reaches there:
never a group's pairs. The components of these edges are those of all links.

Principal directions come from at most SAMPLE vectors and SAMPLE_BYTES; they steer cost, never results.
Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without vec_id, link with nothing (n_links 0, own component); vectors of different
lengths aren't compared; repeated rows count as vectors of their own, and rows that repeat an id with
another vector have their own links; an empty table gives an empty result; label and extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Least cosine; vectors of an interval, and their bytes as doubles; vectors in a leaf; grid dimensions.
COSINE, INTERVAL, INTERVAL_BYTES, LEAF, DIMS = 0.95, 8192, 32 << 20, 512, 8
#: Vectors, and their bytes, that the directions are fitted on; parts into which a stretch is split.
SAMPLE, SAMPLE_BYTES, FAN = 10_000, 32 << 20, 16
SLACK = 1e-6


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, v, h1, h2 (128 bits that name a vector) of every row; v is null where a row links with nothing."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    v = F.transform("embedding", lambda x: F.when(x.cast(kind) == 0.0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind)))  # -0.0 is 0.0
    fine = (
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    )
    rows = vectors.select("vec_id", v.alias("v")).select("vec_id", F.when(fine, F.col("v")).alias("v"))
    return rows.select("vec_id", "v", F.xxhash64(F.lit(0), "v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def nodes(vectors: DataFrame) -> DataFrame:
    """Stored: node (a number), h1, h2, least_id, copies, v: the distinct usable vectors."""
    each = keyed(vectors).where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    return C.written(each.withColumn("node", F.monotonically_increasing_id()), "ego-nodes")


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, each times a power of two that brings its largest component near one: exact, and no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def directions(found: DataFrame, longest: int, dims: int = DIMS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """length -> columns: the leading principal directions of a bounded sample of unit vectors; lengths that it lacks have none."""
    most = max(2, min(sample, SAMPLE_BYTES // (8 * longest)))
    rows = found.select("node", "v").orderBy(F.xxhash64("node")).limit(most).toPandas()["v"]
    out = {}
    for n, part in rows.groupby(rows.map(len)):
        x = unit(np.stack(part.to_numpy()))
        axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2]
        out[int(n)] = axes[: min(dims, x.shape[1])].T
    return out


def placed(found: DataFrame, axes: dict[int, np.ndarray], dims: int) -> DataFrame:
    """node, copies, v, box: ten times the length, then the projections (zeros where there is no direction)."""
    sent = found.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            length = np.diff(v.offsets.to_numpy())
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            box = np.zeros((batch.num_rows, dims + 1))
            box[:, 0] = 10.0 * length
            for n in np.unique(length):
                a = sent.value.get(int(n))
                if a is not None:
                    at = np.flatnonzero(length == n)
                    box[at, 1 : 1 + a.shape[1]] = unit(flat[ends[at][:, None] + np.arange(n)]) @ a
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, box.size + 1, dims + 1, dtype=np.int32)), pa.array(box.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), v, out], names=["node", "copies", "v", "box"])

    kind = found.schema["v"].dataType.simpleString()
    return found.select("node", "copies", "v").mapInArrow(run, f"node bigint, copies bigint, v {kind}, box array<double>")


def ordered(found: DataFrame, axes: dict[int, np.ndarray], eps: float, size: int, dims: int = DIMS) -> DataFrame:
    """Stored: interval (place in epsilon grid order over ``size``), at, node, copies, v, box."""
    cells = [F.floor(F.get("box", F.lit(k)) / eps) for k in range(dims + 1)]
    line = placed(found, axes, dims).orderBy(*cells, "node").withColumn("at", F.monotonically_increasing_id())
    line = C.written(line.withColumn("part", F.shiftright("at", 33)).withColumn("i", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "ego-line")
    sizes = sorted((r.part, r.n) for r in line.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition of the sort
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    start = found.sparkSession.createDataFrame(offsets, "part bigint, first bigint")
    out = C.written(line.join(F.broadcast(start), "part").select(F.floor((F.col("i") + F.col("first")) / size).alias("interval"), "at", "node", "copies", "v", "box"), "ego-order")
    C.drop_path(found.sparkSession, line)
    return out


def gap(a: Column, b: Column, dims: int) -> Column:
    """The squared distance between two bounding boxes."""
    apart = F.transform(F.sequence(F.lit(0), F.lit(dims)), lambda k: F.greatest(F.get(a["lo"], k) - F.get(b["hi"], k), F.get(b["lo"], k) - F.get(a["hi"], k), F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda x, y: x + y * y)


def interval_pairs(line: DataFrame, eps: float, dims: int = DIMS, fan: int = FAN) -> DataFrame:
    """Stored: a, b (a <= b): the intervals whose boxes come within eps, found from the whole sequence downwards."""
    spark = line.sparkSession
    bounds = [f(F.get("box", F.lit(k))).alias(f"{n}{k}") for k in range(dims + 1) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    boxes = line.groupBy(F.col("interval").alias("id")).agg(*bounds)
    boxes = C.written(boxes.select("id", *[F.array(*[f"{n}{k}" for k in range(dims + 1)]).alias(n) for n in ("lo", "hi")]), "ego-boxes")
    last = boxes.agg(F.max("id")).first()[0]
    height = 0
    while fan**height <= last:
        height += 1
    pairs = spark.createDataFrame([(0, 0)], "a bigint, b bigint")
    for level in range(height - 1, -1, -1):
        up, width = fan**level, fan ** (level + 1)
        ends = [f(F.get(n, F.lit(k))).alias(f"{n}{k}") for k in range(dims + 1) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        here = boxes.groupBy(F.floor(F.col("id") / up).alias("id")).agg(*ends).select("id", *[F.array(*[f"{n}{k}" for k in range(dims + 1)]).alias(n) for n in ("lo", "hi")])
        below = here.groupBy(F.floor(F.col("id") * up / width).alias("parent")).agg(F.collect_list(F.struct("id", "lo", "hi")).alias("parts"))  # at most ``fan``
        met = pairs.join(below.select(F.col("parent").alias("a"), F.col("parts").alias("pa")), "a").join(below.select(F.col("parent").alias("b"), F.col("parts").alias("pb")), "b")
        near = lambda x: F.transform(F.filter("pb", lambda y: (x["id"] <= y["id"]) & (gap(x, y, dims) <= (eps + SLACK) ** 2)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))
        done, pairs = pairs, C.written(met.select(F.explode(F.flatten(F.transform("pa", near))).alias("p")).select("p.a", "p.b"), "ego-pairs")
        if level < height - 1:
            C.drop_path(spark, done)
    C.drop_path(spark, boxes)
    return pairs


def joined(pdf: pd.DataFrame, least: float, eps: float, leaf: int) -> pd.DataFrame:
    """node, label, links of one pair of intervals (or of an interval with itself)."""
    length, both_sides = pdf["v"].map(len), pdf["side"].nunique() == 2
    parts = [same_length(part, least, eps, leaf) for _, part in pdf.groupby(length) if not both_sides or part["side"].nunique() == 2]
    return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "label", "links")})


def same_length(pdf: pd.DataFrame, least: float, eps: float, leaf: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["side", "at"])
    x, box = scaled(np.stack(pdf["v"].to_numpy())), np.stack(pdf["box"].to_numpy())
    node, copies, side = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
    norm = np.sqrt((x * x).sum(1))
    unit = (x / norm[:, None]).astype(np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def distant(a: slice, b: slice) -> bool:
        p, q = box[a], box[b]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0.0)
        return float((gap * gap).sum()) > (eps + SLACK) ** 2

    def compare(a: slice, b: slice) -> None:
        near = unit[a] @ unit[b].T >= least - 1e-4
        if a == b:
            np.fill_diagonal(near, False)
        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(i):
            return
        cos = (x[a][i] @ x[b][j].T) / (norm[a][i][:, None] * norm[b][j][None, :])
        hit = near[np.ix_(i, j)] & (cos >= least)
        la, lb, worst = node[a][i].copy(), node[b][j].copy(), np.iinfo(np.int64).max
        while True:
            ra = np.minimum(la, np.where(hit, lb[None, :], worst).min(1))
            rb = np.minimum(lb, np.where(hit, ra[:, None], worst).min(0))
            if (ra == la).all() and (rb == lb).all():
                break
            la, lb = ra, rb
        out.append((node[a][i], la, hit @ copies[b][j]))
        if a != b:
            out.append((node[b][j], lb, copies[a][i] @ hit))

    def join(a: slice, b: slice) -> None:
        na, nb = a.stop - a.start, b.stop - b.start
        if not na or not nb or (a != b and distant(a, b)):
            return
        if na <= leaf and nb <= leaf:
            compare(a, b)
        elif a == b:
            m = (a.start + a.stop) // 2
            join(slice(a.start, m), slice(a.start, m))
            join(slice(m, a.stop), slice(m, a.stop))
            join(slice(a.start, m), slice(m, a.stop))
        elif na >= nb:
            m = (a.start + a.stop) // 2
            join(slice(a.start, m), b)
            join(slice(m, a.stop), b)
        else:
            m = (b.start + b.stop) // 2
            join(a, slice(b.start, m))
            join(a, slice(m, b.stop))

    cut, n = int((side == 0).sum()), len(pdf)
    both = slice(0, n)
    join(*((slice(0, cut), slice(cut, n)) if cut < n else (both, both)))
    if not out:
        return pd.DataFrame({"node": np.zeros(0, np.int64), "label": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
    return pd.DataFrame({k: np.concatenate([o[i] for o in out]).astype(np.int64) for i, k in enumerate(("node", "label", "links"))}).query("links > 0")


def met(found: DataFrame, least: float = COSINE, size: int = INTERVAL, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Stored: node, label, links over all pairs of near intervals."""
    spark = found.sparkSession
    C.ship(spark)
    longest = found.agg(F.max(F.size("v"))).first()[0]
    empty = "node bigint, label bigint, links bigint"
    if longest is None:
        return spark.createDataFrame([], empty)
    size = max(2, min(size, INTERVAL_BYTES // (8 * longest)))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    line = ordered(found, directions(found, longest), eps, size)
    pairs = interval_pairs(line, eps, fan=fan)
    ends = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("interval")).union(pairs.where("a <> b").select("a", "b", F.lit(1), F.col("b")))
    rows = line.join(ends, "interval").select("a", "b", "side", "at", "node", "copies", "v", "box")
    out = C.written(rows.groupBy("a", "b").applyInPandas(lambda pdf: joined(pdf, least, eps, leaf), empty), "ego-links")
    C.drop_path(spark, line)
    return out


def near_duplicates(vectors: DataFrame, least: float = COSINE, size: int = INTERVAL, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    found = nodes(vectors)
    rows = met(found, least, size, leaf, fan)
    links = rows.groupBy("node").agg(F.sum("links").alias("links"))
    labels = C.components(rows.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), "ego-components")
    named = found.select("node", "h1", "h2", "least_id", "copies").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per = named.join(first, "component").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = keyed(vectors).select("vec_id", F.col("v").isNotNull().alias("usable"), "h1", "h2")
    out = each.where("usable").join(per, ["h1", "h2"]).select("vec_id", "component_id", "n_links")
    out = out.unionByName(each.where("not usable").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))


#: Every pair's cosine, and what is reachable over links.
SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND list_count(x) = len(x) AND isfinite(list_max(x)) AND isfinite(list_min(x)) AND (list_max(x) <> 0 OR list_min(x) <> 0)),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, coalesce(v.vec_id = c.component_id, false) AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""
