"""MinHash near-dedup by ProbMinHash: probability Jaccard of weighted five-word shingles, banded and verified.

Each document's distinct shingles, weighted by how often they occur, send
exponential arrivals (rate: the weight) into registers; a shingle stops as soon as
its next arrival is later than the latest register. Registers hold the shingle that
came first, so two documents agree in a register with the probability Jaccard
similarity J_P (equal to the Jaccard similarity where no shingle repeats).

Candidates come from bands in two rounds, over distinct texts. Round one compares each member of a
band's bucket with the bucket's least member; links that verify make components. Round two
takes the buckets that still hold several components and compares their members
across components inside tasks, in blocks, each pair in the first band that it shares; only links that
unite components (or lie at the threshold) come out, so no group's pairs are emitted. A bucket where
more than CHUNK members lie outside its largest component (texts that share a passage, mostly) is
split first by its members' rarest shingles: J_P is at most the mass of what two texts share, so
two texts of similarity s share a shingle among the rarest that make up more than 1 - s
of either (ranked by how many texts of such buckets hold them), and meet there. Every link is verified on the whole texts.

What can be lost: a pair of similarity s shares no band with a chance of (1 - s^4)^24, 3e-6 at 0.8; and a
candidate whose registers agree six standard errors below the threshold (a chance under 1e-6 at 0.8) is not
verified. Nothing else is left out, at any size.

Defined cases: a null text counts as empty; texts without words are alike only if
they are equal; a text of one to four words is one shingle; equal texts are always one
class; class_id is the least non-null doc_id of a class (null if it has none); repeated
rows stay rows of one class; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Registers (bands times rows), words in a shingle, least similarity to link.
BANDS, ROWS, WIDTH, SIMILARITY = 24, 4, 5, 0.8
#: Candidates whose estimate lies so many standard errors below the threshold aren't verified.
ERRORS = 6
#: Members of a block compared in one task; candidate ids up to which they are broadcast (8 bytes each); texts that a task remembers.
CHUNK, MOST_SENT, SEEN = 512, 1_000_000, 200_000
#: Shingles of crowded buckets that are ranked by their counts (12 bytes each in every task).
MOST_RANKED = 50_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before; emptied when it holds many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(texts: list[str | None], memo: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of each distinct shingle of each text, sorted."""
    docs, keys = [], []
    for i, text in enumerate(texts):
        ws = C.byte_words(text)
        if not ws:
            continue
        h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        n = max(1, len(h) - width + 1)
        acc = np.full(n, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            acc = mixed(acc * _GOLD + h[k : k + n])
        docs.append(np.full(n, i, np.int64))
        keys.append(acc)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    out = [np.unique(k, return_counts=True) for k in keys]
    return np.repeat([d[0] for d in docs], [len(u) for u, _ in out]), np.concatenate([u for u, _ in out]), np.concatenate([c for _, c in out]).astype(float)


def registers(n: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """n x m: the shingle that arrived first in each register of each document (0: no shingles)."""
    first, owner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    d, k, w, x = doc, key, weight, np.zeros(len(doc))
    latest = np.full(n, np.inf)
    step = np.zeros(1, np.uint64)
    while len(d):
        step += _GOLD
        r = mixed(k + step)
        x = x - np.log(((r >> np.uint64(12)).astype(float) + 0.5) / 2.0**52) / w
        live = x < latest[d]
        if not live.all():
            d, k, w, x, r = d[live], k[live], w[live], x[live], r[live]
            if not len(d):
                break
        slot = d * m + (mixed(r ^ _GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, x)
        won = x == first[slot]
        owner[slot[won]] = k[won]
        some = np.unique(d) if len(d) < 4 * n else slice(None)
        latest[some] = first.reshape(n, m)[some].max(1)
    return owner.reshape(n, m)


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)) * _GOLD
    for j in range(rows):
        acc = mixed(acc ^ parts[:, :, j]) + _GOLD
    return acc.view(np.int64)


def jp(xk: np.ndarray, xw: np.ndarray, yk: np.ndarray, yw: np.ndarray) -> float:
    """The exact probability Jaccard similarity of two weighted sets (keys sorted)."""
    if not len(xk) or not len(yk):
        return 0.0
    keys = np.union1d(xk, yk)
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, xk)], y[np.searchsorted(keys, yk)] = xw, yw
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.maximum(y, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    above = np.concatenate([np.cumsum(xs[::-1])[::-1], [0.0]])  # x from here on
    below = np.concatenate([[0.0], np.cumsum(ys)])  # y before here
    at = np.searchsorted(r, ratio[both], side="left")
    return float(np.sum(1 / (above[at] / x[both] + below[at] / y[both])))


def signatures(docs: DataFrame, seed: int = 0, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, node and check (two hashes of the text) of every document; bands and sig at least once for each text (else empty)."""
    spark = docs.sparkSession
    C.ship(spark)
    m = bands * rows
    text = F.coalesce(F.col("text"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                n, texts = part.num_rows, part.column("text").to_pylist()
                if len(seen) > SEEN:
                    seen.clear()
                for i, node in enumerate(part.column("node").to_pylist()):
                    if node in seen:
                        texts[i] = None  # a copy: its text has its sketch already
                    seen.add(node)
                doc, key, weight = shingles(texts, memo, width)
                sig = registers(n, doc, key, weight, m)
                full = np.zeros(n, bool)
                full[doc] = True
                flat = bands_of(sig, bands, rows)[full].ravel()
                ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                low = np.ascontiguousarray(sig.astype(np.uint32))
                sigs = pa.array([low[i].tobytes() if full[i] else b"" for i in range(n)], pa.binary())
                cols = [part.column(c) for c in ("doc_id", "node", "check")]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), sigs], names=["doc_id", "node", "check", "bands", "sig"])

    source = docs.select("doc_id", F.xxhash64(F.lit(seed), text).alias("node"), F.xxhash64(F.lit(seed + 1), text).alias("check"), "text")
    return source.mapInArrow(C.thrifty(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node bigint, check bigint, bands array<bigint>, sig binary")


def alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose registers agree often enough to be worth verifying."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array((sa == sb).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(C.thrifty(run), "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, seed: int, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose whole texts have a probability Jaccard similarity of ``least`` or more."""
    nodes = C.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "minhash-nodes")
    texts = docs.select(F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("node"), "text")
    few = nodes.limit(MOST_SENT + 1).count() <= MOST_SENT
    texts = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last = WordHashes(), (None, None)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = batch.column("a")[i].as_py()
                if last[0] != a:
                    last = (a, shingles([batch.column("ta")[i].as_py()], memo, width)[1:])
                keep[i] = jp(*last[1], *shingles([batch.column("tb")[i].as_py()], memo, width)[1:]) >= least - 1e-12
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(C.thrifty(run), "a bigint, b bigint")


def shingled(docs: DataFrame, nodes: DataFrame, seed: int, width: int) -> DataFrame:
    """node, keys (32-bit shingle hashes, sorted), counts of one text of each of ``nodes``."""
    texts = docs.select(F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias("node"), "text")
    few = nodes.limit(MOST_SENT + 1).count() <= MOST_SENT
    texts = texts.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            keys, counts = [], []
            for text in batch.column("text").to_pylist():
                _, key, count = shingles([text], memo, width)
                low, at = np.unique(key.astype(np.uint32), return_index=True)
                keys.append(low.tobytes())
                counts.append(np.minimum(count[at], 2**32 - 1).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["node", "keys", "counts"])

    return texts.mapInArrow(C.thrifty(run), "node bigint, keys binary, counts binary")


def compared(pdf: pd.DataFrame, least: float, estimate: float, margin: float = 0.01) -> pd.DataFrame:
    """Links to verify between components of one task: those that unite two, and all near the threshold.

    Rows of side 0 are compared with those of side 1; where there is one side alone, with each
    other. Similarities come from 32-bit shingle hashes through an inverted list of the task; a
    pair is looked at in the first band that it shares only.
    """
    node, comp, side = pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf["side"].to_numpy()
    alone = side.min() == side.max()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
    bands = np.stack(pdf["bands"].to_numpy())
    here = int(np.argmax(bands[0] == pdf["band"].iloc[0]))
    keys = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    counts = [np.frombuffer(c, np.uint32).astype(float) for c in pdf["counts"]]
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(k) for k in keys])
    even = np.array([len(c) > 0 and c.min() == c.max() for c in counts])
    _, root = np.unique(comp, return_inverse=True)
    out: list[tuple[int, int]] = []
    for i in range(len(pdf)) if alone else np.flatnonzero(side == 0):
        near = np.flatnonzero((root != root[i]) & ((node > node[i]) if alone else (side == 1)))
        near = near[(bands[near] == bands[i]).argmax(1) == here]
        if not len(near):
            continue
        lo, hi = np.searchsorted(flat, keys[i], "left"), np.searchsorted(flat, keys[i], "right")
        span = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
        shared = np.bincount(owner[at], minlength=len(keys))[near]
        like = shared / (size[near] + size[i] - shared)
        for k in np.flatnonzero(~(even[near] & even[i])):
            j = near[k]
            like[k] = jp(keys[i], counts[i], keys[j], counts[j]) if shared[k] and (sig[i] == sig[j]).mean() >= estimate else 0.0
        for k in np.argsort(-like):
            j = near[k]
            if like[k] < least - margin:
                break
            if root[i] != root[j]:
                out.append((min(node[i], node[j]), max(node[i], node[j])))
                if like[k] >= least + margin:
                    root[root == root[j]] = root[i]
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def groups_of(named: DataFrame, key: list[str]) -> DataFrame:
    """key, main (the largest component), n (members), others (members outside it) of groups with several components."""
    per = named.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "component"))
    return per.groupBy(*key).agg(most.alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("several")).where("several > 1").select(*key, F.col("m.component").alias("main"), "n", (F.col("n") - F.col("m.n")).alias("others"))


def dealt(named: DataFrame, groups: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """band, key, task, side, node, component: blocks of at most about ``chunk`` members on either side that cover every pair across components.

    A small group is one task. Otherwise blocks of the largest component meet blocks of the others, and blocks of
    the others meet each other: members are copied as often as their opposite has blocks, once where the others are few.
    """
    block = lambda n: F.greatest(F.ceil(n / F.lit(chunk)).cast("int"), F.lit(1))
    h = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)).cast("int")
    rows = named.join(groups, key).withColumn("mains", block(F.col("n") - F.col("others"))).withColumn("blocks", block(F.col("others")))
    own = F.col("component") == F.col("main")
    task = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    zero = F.lit(0)
    met = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: task(1, h % F.col("mains"), k, 0))
    meet = F.transform(F.sequence(zero, F.col("mains") - 1), lambda k: task(1, k, h % F.col("blocks"), 1))
    b = h % F.col("blocks")
    each = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda k: F.struct(F.lit(2).alias("kind"), F.least(b, k).alias("x"), F.greatest(b, k).alias("y"), (b > k).cast("int").alias("side")))
    tasks = F.when(F.col("n") <= chunk, F.array(task(0, zero, zero, 0))).when(own, met).otherwise(F.concat(meet, each))
    return rows.select(*key, "node", "component", F.explode(tasks).alias("t")).select(*key, "t.kind", "t.x", "t.y", "t.side", "node", "component")


def frequent(own: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Shingles (sorted) that the most texts of ``own`` hold, how many do, and whether no other shingle stands in two texts.

    At most ``most`` of them, from a power of two of their counts on: this bounds what reaches the driver, and orders shingles; it leaves none out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["shingle", "n"])

    often = own.select("keys").mapInArrow(C.thrifty(run), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    often = C.written(often.withColumn("level", F.floor(F.log2("n")).cast("int")), "minhash-often")
    left, bar = most, None
    levels = often.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in sorted(levels, key=lambda r: -r.level):
        if r.n > left:
            break
        left, bar = left - r.n, r.level
    rows = [] if bar is None else often.where(F.col("level") >= bar).select("shingle", "n").collect()
    C.drop_path(often.sparkSession, often)
    got = np.array(sorted((r.shingle, r.n) for r in rows), np.int64).reshape(-1, 2)
    return got[:, 0].astype(np.uint32), got[:, 1], len(rows) == sum(r.n for r in levels)


def rarest(named: DataFrame, known: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """band, node, component, shingle: the rarest shingles of each member, as many as hold more than 1 - ``least`` of its mass.

    All texts rank their shingles alike: by how many texts of ``named`` hold them (0 beyond the ``most`` frequent), then by hash. Shingles that
    are known to stand in one text alone count as mass, but meet nothing and don't come out.
    """
    own = C.written(known.join(named.select("node").distinct(), "node", "left_semi").select("node", "keys", "counts"), "minhash-crowd")
    common, n, whole = frequent(own, MOST_RANKED if most is None else most)
    sent = own.sparkSession.sparkContext.broadcast((common, n, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, n, whole = sent.value
        for batch in batches:
            kept = []
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32).astype(float)
                at = np.searchsorted(common, keys)
                hit = np.zeros(len(keys), bool)
                hit[at < len(common)] = common[at[at < len(common)]] == keys[at < len(common)]
                rank = np.zeros(len(keys), np.int64)
                rank[hit] = n[at[hit]]
                order = np.lexsort((keys, rank))
                first = order[: np.searchsorted(np.cumsum(counts[order]) / counts.sum(), 1 - least + 1e-9, side="right") + 1]
                kept.append(keys[first[hit[first]] if whole else first].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(kept, pa.list_(pa.int64()))], names=["node", "kept"])

    firsts = own.mapInArrow(C.thrifty(run), "node bigint, kept array<bigint>")
    return named.join(firsts, "node").select("band", "node", "component", F.explode("kept").alias("shingle"))


def across(docs: DataFrame, rows: DataFrame, sigs: DataFrame, labels: DataFrame, seed: int, least: float, estimate: float, width: int) -> DataFrame:
    """Pairs to verify between different components that meet in a bucket; rows: band, lead, node."""
    named = C.written(rows.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "minhash-named")
    groups = C.written(groups_of(named, ["band"]), "minhash-groups")
    mixed = named.join(groups.select("band"), "band", "left_semi")
    known = C.written(shingled(docs, C.written(mixed.select("node").distinct(), "minhash-mixed-nodes"), seed, width).join(sigs, "node"), "minhash-shingles")
    key = ["band", "shingle"]
    plain = groups.where(F.col("others") <= CHUNK)
    tasks = dealt(named, plain, ["band"], CHUNK).withColumn("shingle", F.lit(-1).cast("bigint"))
    if groups.where(F.col("others") > CHUNK).limit(1).count():
        crowd = named.join(groups.where(F.col("others") > CHUNK).select("band"), "band", "left_semi")
        split = C.written(rarest(crowd, known, least), "minhash-rarest")
        tasks = tasks.unionByName(dealt(split, groups_of(split, key), key, CHUNK))
    tasks = C.written(tasks, "minhash-mixed")
    return tasks.join(known, "node").groupBy(*key, "kind", "x", "y").applyInPandas(lambda pdf: compared(pdf, least, estimate), "a bigint, b bigint").distinct()


def classed(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[DataFrame, int]:
    """doc_id, node (hash of the text), component and class_id of every row of ``docs``, and the hash's seed; reads doc_id and text."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    estimate = least - ERRORS * (least * (1 - least) / (bands * rows)) ** 0.5
    for seed in itertools.count(0, 2):
        base = C.written(signatures(docs, seed, bands, rows, width), "minhash-signatures")
        per = C.written(base.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.count(F.lit(1)).alias("copies")), "minhash-texts")
        if not per.where("lo <> hi").limit(1).count():
            break  # no two texts share a hash
        C.drop_path(spark, base)
    sigs = C.written(base.where(F.size("bands") > 0).groupBy("node").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands")), "minhash-sketches")
    row = sigs.select("node", F.explode("bands").alias("band"))
    lead = C.written(row.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("hi")).where("lead <> hi").drop("hi"), "minhash-buckets")
    member = C.written(row.join(lead, "band").select("band", "lead", "node"), "minhash-members")
    star = C.written(member.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "minhash-stars")
    met = star.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    near = C.written(sigs.join(met, "node", "left_semi"), "minhash-compared")
    links = C.written(verified(C.written(alike(star, near, estimate), "minhash-pairs"), docs, seed, least, width), "minhash-links")
    labels = C.components(links, "minhash-components")
    more = C.written(across(docs, member, near, labels, seed, least, estimate, width), "minhash-across")
    if more.limit(1).count():
        found = C.written(verified(more, docs, seed, least, width), "minhash-links2")
        if found.limit(1).count():
            labels = C.components(links.union(found), "minhash-components2")
    for done in (sigs, lead, member, star, near, more):
        C.drop_path(spark, done)
    owned = per.join(labels, "node", "left").select("node", "least_id", "copies", F.coalesce("component", "node").alias("component"))
    first = owned.groupBy("component").agg(F.min("least_id").alias("class_id"))
    named = C.written(owned.join(first, "component").select("node", "component", "class_id", "copies"), "minhash-named-texts")
    return C.spread_join(base.select("doc_id", "node"), named, "node"), seed


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, node (hash of the text) and class_id of every row of ``docs``; reads doc_id and text."""
    return classed(docs, least, bands, rows, width)[0].select("doc_id", "node", "class_id")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: of its texts and rows with the least doc_id (nulls last) any one."""
    found, seed = classed(docs)
    found = C.written(found, "minhash-classes")
    id_, node, at = (C.fresh(docs, n) for n in ("_id", "_node", "_at"))
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("m"))
    stay = C.written(least.select(F.col("m.doc_id").alias(id_), F.col("m.node").alias(node)), "minhash-kept")
    few = stay.limit(MOST_SENT + 1).count() <= MOST_SENT
    small = F.broadcast(stay) if few else stay

    def of(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(small, rows["doc_id"].eqNullSafe(F.col(id_)) & (F.col(name) == F.col(node)), "left_semi")

    again = of(found, "node").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    kept = of(docs.withColumn(at, F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")))), at)
    return (kept.dropDuplicates([at]) if again else kept).select(*docs.columns)
