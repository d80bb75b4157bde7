"""Cross-tokenizer alignment: which tokens of two vocabularies stand over the same bytes, and how often over the corpus.

The ends of both tokenizations of a stretch of text, in bytes, are united (``union1d``); between
two neighbouring ends lies one elementary interval, ``searchsorted`` gives the token of
either side that owns it, and that is one overlap. Ends that both have close a group;
``products`` expands groups to pairs. One pass over the texts stores, for each document,
its distinct linked pairs of ids with their numbers; Spark sums these over the corpus, and a second
pass over the stored pairs gives each document its sums. The most frequent pairs are
broadcast, up to MOST_SENT of them; documents meet all others by a join on the pair.

Both libraries get texts cut before single spaces between two printing characters.
Neither crosses such a cut: a byte-level split begins a new part at a space behind a printing character, and
pieces that hold a space only at their front can't be merged over it. ``Aligner`` verifies these properties of the
files and takes texts whole where they lack one. Equal parts are encoded once while they are remembered.

Defined cases: null and empty texts, and texts whose tokens do not spell them (for example those with U+2581), have no tokens;
a text of any length is aligned whole, part by part; repeated rows count each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Cuts that no token of either library crosses.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Parts remembered, and their longest; tokens aligned at once; pairs of documents held before rows are handed on; pairs that are broadcast.
KNOWN, LONG, TOKENS, HELD, MOST_SENT = 200_000, 64, 200_000, 2_000_000, 1_000_000
#: Parts that may be encoded side by side, and how many at once.
PLAIN, SIDE = re.compile(r"[!-~\w](?:.*[!-~\w])?", re.DOTALL), 500

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>, groups string"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printing ones as themselves, the others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library; special strings are plain text."""

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(raw.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        config, letters = json.loads(raw), byte_letters()
        pre = config.get("pre_tokenizer") or {}
        self.cuts = not config.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        spelled = {i: bytes(letters[c] for c in s) if set(s) <= set(letters) else s.encode() for s, i in self.lib.get_vocab().items()}
        self.spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.lib.encode_batch_fast([f" {t}"], add_special_tokens=False)[0].ids for t in texts]


class Pieces:
    """A model of the sentencepiece library, which puts a space in front."""

    def __init__(self, raw: bytes) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        inner = any("▁" in p.lstrip("▁") for p in pieces)
        kept = "a  béﬁÅ  "  # neither spaces nor compatibility forms change
        self.cuts = not inner and b"".join(map(self.spelled.__getitem__, self.lib.encode(kept))) == f" {kept}".encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)


def union1d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy's, for two rising arrays: a stable sort merges them in one pass."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both


def elementary(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, the A token and the B token that own each, and the ends that both share."""
    ends = union1d(a_ends, b_ends)
    a_own, b_own = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a_own, b_own, ends[(a_ends[a_own] == ends) & (b_ends[b_own] == ends)]


class Aligner:
    """Both tokenizers, what they made of parts seen lately, and the alignment of a run of documents."""

    def __init__(self, a_raw: bytes, b_raw: bytes) -> None:
        self.a, self.b = ByteLevel(a_raw), Pieces(b_raw)
        self.cuts = self.a.cuts and self.b.cuts
        self.a_len, self.b_len = (np.array([len(s) for s in t.spelled], np.int64) for t in (self.a, self.b))
        self.n, self.known, self.older = max(len(self.a_len), len(self.b_len)), {}, {}
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in range(self.n)], "S")

    def learn(self, parts: set[str]) -> dict[str, tuple[bytes, bytes] | tuple[()]]:
        """The ids (four bytes each) of parts that are not in ``known`` on both sides; empty if they don't spell it.

        The last KNOWN parts, and those before them that were seen since, are remembered, but for long ones.
        """
        found = {p: self.older[p] for p in parts if p in self.older}
        new = [p for p in parts if p not in found]
        plain = [p for p in new if self.cuts and PLAIN.fullmatch(p)]
        for k in range(0, len(plain), SIDE):
            found |= self.encoded(plain[k : k + SIDE])
        for p in set(new).difference(plain):
            found |= self.encoded([p])
        if len(self.known) + len(found) > KNOWN:
            self.known, self.older = {}, self.known
        self.known |= {p: v for p, v in found.items() if len(p) <= LONG}
        return found

    def encoded(self, parts: list[str]) -> dict[str, tuple[bytes, bytes] | tuple[()]]:
        """Parts side by side, with a space between, where no token crosses; one by one if these aren't spelled."""
        text = " ".join(parts)
        want = f" {text}".encode()
        ids = [self.a.encode([text])[0], self.b.encode([text])[0]]
        if any(b"".join(map(t.spelled.__getitem__, x)) != want for t, x in zip((self.a, self.b), ids, strict=True)):
            return {p: v for x in parts for p, v in self.encoded([x]).items()} if len(parts) > 1 else {text: ()}
        borders = np.cumsum([len(p.encode()) + 1 for p in parts])
        sides = []
        for x, lengths in zip(ids, (self.a_len, self.b_len), strict=True):
            x = np.array(x, np.int32)
            at = [0, *(4 * np.searchsorted(lengths[x].cumsum(), borders, "right")).tolist()]
            raw = x.tobytes()
            sides.append([raw[i:j] for i, j in zip(at, at[1:], strict=False)])
        return dict(zip(parts, zip(*sides, strict=True), strict=True))

    def aligned(self, texts: list[str | None], keep: bool) -> Iterator[dict]:
        """A record for each text, in order."""
        wait: list[Document] = []
        run: list[tuple[Document, list[str]]] = []
        size = 0
        for t in texts:
            doc = Document(keep)
            wait.append(doc)
            parts = (CUT.split(t) if self.cuts else [t]) if t else []
            for k in range(0, len(parts), TOKENS):
                run.append((doc, parts[k : k + TOKENS]))
                size += sum(map(len, run[-1][1])) // 4 + len(run[-1][1])
                if size >= TOKENS:
                    self.align(run)
                    run, size = [], 0
            if not run:
                yield from (d.record() for d in wait)
                wait = []
        self.align(run)
        yield from (d.record() for d in wait)

    def align(self, run: list[tuple[Document, list[str]]]) -> None:
        """All stretches of a run at once, laid end to end: as both sides spell them, their borders are shared ends."""
        get, seen, missing = self.known.get, [], set()
        for _, ps in run:
            seen.append([get(p) for p in ps])
            if None in seen[-1]:
                missing.update(p for p, v in zip(ps, seen[-1], strict=True) if v is None)
        found = self.learn(missing)
        docs, a_ids, b_ids = [], [], []
        for (doc, ps), both in zip(run, seen, strict=True):
            if None in both:
                both = [found[p] if v is None else v for p, v in zip(ps, both, strict=True)]
            if () in both:
                doc.spelled = False
            if doc.spelled:
                docs.append(doc)
                a_ids.append(b"".join([v[0] for v in both]))
                b_ids.append(b"".join([v[1] for v in both]))
        if not docs:
            return
        a, b = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (a_ids, b_ids))
        a_n, b_n = ([len(i) // 4 for i in x] for x in (a_ids, b_ids))
        a_ends, b_ends = self.a_len[a].cumsum(), self.b_len[b].cumsum()
        ends, a_own, b_own, shared = elementary(a_ends, b_ends)
        borders = a_ends[np.cumsum(a_n) - 1]
        links, closed = np.searchsorted(ends, borders, "right"), np.searchsorted(shared, borders, "right")
        # distinct pairs of each stretch
        pairs = a[a_own] * len(self.b_len) + b[b_own]
        owner = np.repeat(np.arange(len(docs)), np.diff(links, prepend=0))
        order = np.lexsort((pairs, owner))
        pairs, owner = pairs[order], owner[order]
        first = np.flatnonzero(np.r_[True, (np.diff(pairs) != 0) | (np.diff(owner) != 0)])
        times = np.diff(np.r_[first, len(pairs)])
        pairs, cuts = pairs[first], np.searchsorted(owner[first], np.arange(len(docs) + 1))
        # a group's A tokens, then its B tokens, each with the sign that follows it
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        a_last, b_last = np.r_[a_group[1:] != a_group[:-1], True], np.r_[b_group[1:] != b_group[:-1], True]
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + self.n * a_last
        signs[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b + 2 * self.n * b_last
        at = np.r_[0, np.cumsum(np.array(a_n) + np.array(b_n))].tolist()
        links, closed = np.diff(links, prepend=0).tolist(), np.diff(closed, prepend=0).tolist()
        for k, doc in enumerate(docs):
            written = self.names[signs[at[k] : at[k + 1]]].tobytes().replace(b"\0", b"")
            doc.add(a_n[k], b_n[k], closed[k], links[k], pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]], written)


class Document:
    """What the stretches of a document add up to."""

    def __init__(self, keep: bool) -> None:
        self.counts, self.pairs, self.written, self.spelled, self.keep = [0, 0, 0, 0], [], [], True, keep
        self.hash, self.tail = hashlib.sha256(), b""

    def add(self, a: int, b: int, groups: int, links: int, pairs: np.ndarray, times: np.ndarray, written: bytes) -> None:
        self.counts = [x + y for x, y in zip(self.counts, (a, b, groups, links), strict=True)]
        self.pairs.append((pairs, times))
        if len(self.pairs) >= 64:
            self.pairs = [self.summed()]
        self.hash.update(self.tail + written[:-1])
        self.tail = b";"
        if self.keep:
            self.written.append(written)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        codes, at = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([t for _, t in self.pairs])).astype(np.int64)

    def record(self) -> dict:
        if not self.spelled or not self.counts[0]:
            none = np.zeros(0, np.int64)
            return {"counts": [0] * 4, "sha": "", "pairs": (none, none), "groups": "" if self.keep else None}
        return {"counts": self.counts, "sha": self.hash.hexdigest(), "pairs": self.summed(), "groups": b"".join(self.written)[:-1].decode() if self.keep else None}


@lru_cache(maxsize=1)
def aligner(a_raw: bytes, b_raw: bytes) -> Aligner:
    """Once for each Python worker."""
    return Aligner(a_raw, b_raw)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def packed(ids: list[tuple[int, int]], found: list[dict]) -> pa.RecordBatch:
    counts = [pa.array([f["counts"][k] for f in found], pa.int64()) for k in range(4)]
    columns = [pa.array([i for i, _ in ids], pa.int64()), pa.array([d for _, d in ids], pa.int64()), *counts, pa.array([f["sha"] for f in found], pa.string())]
    columns += [lists([f["pairs"][0] for f in found], pa.int64()), lists([f["pairs"][1] for f in found], pa.int32()), pa.array([f["groups"] for f in found], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def alignments(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """row, doc_id, counts, distinct pairs (``codes``: A id * size of B + B id) with ``times``, and on demand ``groups`` as text, of each document."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast((read_bytes(a_path), read_bytes(b_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = aligner(*sent.value)
        for batch in batches:
            keys = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            ids, found, held = [], [], 0
            for key, record in zip(keys, both.aligned(batch.column("text").to_pylist(), keep_groups), strict=True):
                ids.append(key)
                found.append(record)
                held += len(record["pairs"][0]) + len(record["groups"] or "") // 12
                if held >= HELD:
                    yield packed(ids, found)
                    ids, found, held = [], [], 0
            yield packed(ids, found)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """code, n (links of the pair over the corpus), best (no pair of its B id has more)."""
    each = rows.select(F.explode(F.arrays_zip("codes", "times")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.times").alias("t"))
    counts = C.written(each.groupBy("code").agg(F.sum("t").alias("n")), "alignment-counts")
    most = counts.groupBy((F.col("code") % b_size).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    return counts.join(F.broadcast(most), F.col("code") % b_size == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def sent_from(counts: DataFrame) -> tuple[int, bool]:
    """The least power of two from which on at most MOST_SENT pairs have such counts, and whether others remain."""
    sizes = dict(counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count(F.lit(1))).collect())  # at most 64 rows
    left = MOST_SENT
    for k in sorted(sizes, reverse=True):
        left -= sizes[k]
        if left < 0:
            return 1 << k, True
    return 0, False


def with_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with n_best and count_sum; ``counts`` as of ``pair_counts``, stored."""
    spark = rows.sparkSession
    bar, more = sent_from(counts)
    table = counts.where(F.col("n") >= bar).toArrow().sort_by("code")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))
    rest = counts.where(F.col("n") < bar) if more else None
    kept = [c for c in rows.columns if c not in ("codes", "times")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            lengths = np.diff(batch.column("codes").offsets.to_numpy())
            pairs = batch.column("codes").flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = np.minimum(np.searchsorted(code, pairs), max(len(code) - 1, 0))
            hit = code[at] == pairs if len(code) else np.zeros(len(pairs), bool)
            own, t, at = owner[hit], times[hit], at[hit]
            sums = np.zeros((2, len(lengths)), np.int64)
            np.add.at(sums[0], own, t * best[at])
            np.add.at(sums[1], own, t * n[at])
            parts = np.bincount(owner[~hit], minlength=len(lengths)).cumsum()
            offsets = pa.array(np.r_[0, parts], pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit], pa.int64())) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums[0]), pa.array(sums[1]), *left], names=[*kept, "n_best", "count_sum", "codes", "times"])

    out = rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_best long, count_sum long, codes array<long>, times array<long>")
    if rest is None:
        return out.drop("codes", "times")
    out = C.written(out, "alignment-sums")
    rare = out.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("t"))
    rare = rare.join(rest, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_best"), F.sum(F.col("t") * F.col("n")).alias("_sum"))
    out = out.drop("codes", "times").join(rare, "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return out.withColumns(added).drop("_best", "_sum")


def products(aligned: DataFrame) -> DataFrame:
    """doc_id, group, a, b: each pair of an A and a B id of each group of ``alignments(..., keep_groups=True)``."""
    groups = aligned.where("groups <> ''").select("doc_id", F.posexplode(F.split("groups", ";")).alias("group", "g"))
    ids = lambda k: F.split(F.split("g", r"\|")[k], ",")
    out = groups.withColumn("a", F.explode(ids(0))).withColumn("b", F.explode(ids(1)))
    return out.select("doc_id", "group", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and the corpus-wide counts of linked ids, of every document."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = C.written(alignments(C.table(spark, sf_dir, "documents"), a, b).drop("groups"), "alignment-rows")
    counts = C.written(pair_counts(rows, len(Pieces(read_bytes(b)).spelled)), "alignment-pairs")
    return with_sums(rows, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
