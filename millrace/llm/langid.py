"""Language identification with a linear-chain conditional random field over words.

Each word has affix, character n-gram, shape and lexicon features, hashed into one table
of weights for each language; learned transitions tie neighbouring words. Forward-backward
gives every word's probability of every language, also where a text switches between
languages; a text's language has the largest mean over its words, weighted by length.

Training knows only the languages of documents: a first pass fits words by themselves, the
training texts are labelled again with sticky transitions, so that switched stretches get
their own language, and the field is then fitted to these sequences. Forward-backward runs
over blocks of words: transfer matrices of all blocks at once, a scan over each text's
blocks, then all blocks again; a giant text goes in stretches. It is exact for texts of any length.

Defined cases: null texts and texts without letters are ``und`` with score 0; ties go to the first
language in alphabetical order; without training rows all is ``und``; repeated rows score alike;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Training texts taken for each language, and of all languages; hashed features; words in a block.
MOST_EACH, MOST_ROWS, SPACE, BLOCK = 400, 50_000, 1 << 16, 64
#: Words whose messages are held at once; words that a task remembers.
AT_ONCE, KEPT = 60_000, 400_000


class Hashes(dict):
    """feature -> its place in the table of weights; emptied when it holds many."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        h = self[feature] = zlib.crc32(feature.encode()) % SPACE
        return h


#: Two- and three-grams, and all other features, of this process.
GRAMS, OTHERS = Hashes(), Hashes()


def features(word: str, lexicon: set[str]) -> list[int]:
    """Places of a word's affixes, all of its two- and three-grams, length, script and place in the lexicon."""
    padded = f"<{word}>"
    named = [f"p{padded[: k + 1]}" for k in (1, 2, 3)] + [f"s{padded[-k - 1 :]}" for k in (1, 2, 3)]
    named += [f"n{min(len(word), 12)}", "a" if word.isascii() else "u"] + [f"w{word}"] * (word in lexicon)
    grams, n = GRAMS, len(padded)
    return [OTHERS[f] for f in named] + [grams[padded[i : i + 2]] for i in range(n - 1)] + [grams[padded[i : i + 3]] for i in range(n - 2)]


class Words(dict):
    """word (bytes) -> number of its row, -1 for words without letters; the rows' features are ragged."""

    def __init__(self, lexicon: set[str]):
        super().__init__()
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.starts, self.scores, self.n = array("i"), array("q"), array("f"), 0

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace").lower()
        if any(map(str.isalpha, word)):
            self[raw] = self.n
            self.n += 1
            self.starts.append(len(self.flat))
            self.flat.extend(features(word, self.lexicon))
        else:
            self[raw] = -1
        return self[raw]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """All features, row after row, and where each row starts; as copies."""
        return np.array(self.flat, np.int32), np.array(self.starts, np.int64)

    def emissions(self, w: np.ndarray) -> np.ndarray:
        """The summed weights of every word met so far; features of new words are summed, a bounded number at a time, and let go."""
        flat, starts = self.rows()
        ends, lo = np.append(starts[1:], len(flat)), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 32 * AT_ONCE // max(4, w.shape[1]), "right")))
            self.scores.frombytes(np.add.reduceat(w[flat[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], axis=0).astype(np.float32).tobytes())
            lo = hi
        self.flat, self.starts = array("i"), array("q")
        return np.array(self.scores, np.float32).reshape(-1, w.shape[1])


def blocks_of(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its place in padded blocks; and each text's number of blocks."""
    n = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) * block
    place = np.repeat(first - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return place, n


def block_matrices(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, block: int, begins: bool) -> tuple:
    """Padded emissions, which of them are real, first blocks of texts, log transitions' exponents and the blocks' transfer matrices."""
    size = e.shape[1]
    place, n = blocks_of(lengths, block)
    total = int(n.sum())
    t = np.exp(trans - trans.max())
    flat, real = np.ones((total * block, size)), np.zeros(total * block, bool)
    flat[place] = np.exp(e - e.max(1, keepdims=True))
    real[place] = True
    x, real = flat.reshape(total, block, size), real.reshape(total, block)
    top = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(int)
    start = np.zeros(total, bool)
    start[top[n > 0]] = begins
    m = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for k in range(block):
        step = m @ t * x[:, None, k]
        if k == 0:
            step[start] = x[start, None, 0]
        step /= step.sum((1, 2), keepdims=True)
        m = np.where(real[:, k, None, None], step, m)
    return place, n, x, real, top, start, t, m


def marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool, block: int, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word and expected transitions; ``enter`` and ``leave``: messages at the ends of one stretch of a text."""
    size = e.shape[1]
    if not lengths.sum():
        return np.zeros((0, size)), np.zeros((size, size))
    place, n, x, real, top, start, t, m = block_matrices(e, lengths, trans, block, enter is None)
    total = len(x)
    fwd, bwd = np.full((total, size), 1 / size), np.full((total, size), 1 / size)
    if enter is not None:
        fwd[0] = enter
    if leave is not None:
        bwd[-1] = leave
    order = np.argsort(-n, kind="stable")
    for k in range(1, int(n.max())):
        at = top[order[: int((n > k).sum())]] + k
        v = np.einsum("ai,aij->aj", fwd[at - 1], m[at - 1])
        fwd[at] = v / v.sum(1, keepdims=True)
    for k in range(int(n.max()) - 2, -1, -1):
        at = top[order[: int((n > k + 1).sum())]] + k
        v = np.einsum("aij,aj->ai", m[at + 1], bwd[at + 1])
        bwd[at] = v / v.sum(1, keepdims=True)
    alpha, a = np.empty_like(x), fwd
    expected = np.zeros((size, size))
    for k in range(block):
        step = a @ t * x[:, k]
        if k == 0:
            step[start] = x[start, 0]
        step /= step.sum(1, keepdims=True)
        a = np.where(real[:, k, None], step, a)
        alpha[:, k] = a
    beta, b = np.empty_like(x), bwd
    for k in range(block - 1, -1, -1):
        beta[:, k] = b
        step = (x[:, k] * b) @ t.T
        if pairs:
            before = alpha[:, k - 1] if k else fwd
            xi = before[:, :, None] * t[None] * (x[:, k] * b)[:, None, :]
            use = real[:, k] & ~(start & (k == 0))
            xi = xi[use]
            expected += (xi / np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        step /= np.maximum(step.sum(1, keepdims=True), 1e-300)
        b = np.where(real[:, k, None], step, b)
    p = (alpha * beta).reshape(-1, size)[place]
    return p / p.sum(1, keepdims=True), expected


def batches_of(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts that hold at most ``most`` words together, or one text."""
    a = 0
    ends = np.cumsum(lengths)
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def forward_backward(emit: Callable[[int, int], np.ndarray], lengths: np.ndarray, trans: np.ndarray, pairs: bool = False, block: int = BLOCK, most: int = AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first word, text or -1, marginals, expected transitions) of stretches of at most ``most`` words, in order.

    ``emit(a, b)`` gives the emissions of words a to b. A text longer than ``most`` words goes in
    stretches: their transfer matrices first, a scan of messages over them, then each
    stretch by itself, so that memory does not grow with the longest text.
    """
    size, at = len(trans), 0
    most = max(block, most * 16 // max(16, size * size))  # with many languages fewer words at once
    for a, b in batches_of(lengths, most):
        n = int(lengths[a:b].sum())
        if n <= most:
            yield at, a, *marginals(emit(at, at + n), lengths[a:b], trans, pairs, block)
        else:
            cuts = [*range(at, at + n, most), at + n]
            spans = list(zip(cuts, cuts[1:], strict=False))
            mats = []
            for k, (lo, hi) in enumerate(spans):
                acc = np.eye(size)
                for m in block_matrices(emit(lo, hi), np.array([hi - lo]), trans, block, k == 0)[-1]:
                    acc = acc @ m
                    acc /= acc.sum()
                mats.append(acc)
            enter, leave = [None], [np.full(size, 1 / size)]
            for m in mats[:-1]:
                v = (np.full(size, 1 / size) if enter[-1] is None else enter[-1]) @ m
                enter.append(v / v.sum())
            for m in mats[:0:-1]:
                v = m @ leave[-1]
                leave.append(v / v.sum())
            for (lo, hi), into, out in zip(spans, enter, leave[::-1], strict=True):
                yield lo, a, *marginals(emit(lo, hi), np.array([hi - lo]), trans, pairs, block, into, out)
        at += n


def fit(rows: list[tuple[str, str]], rounds: int = 12, chain_rounds: int = 6) -> dict:
    """Languages, hashed weights and transitions from (text, lang)."""
    nothing = {"langs": [], "w": np.zeros((SPACE, 1), np.float32), "trans": np.zeros((1, 1)), "lexicon": set()}
    langs = sorted({y for _, y in rows})
    texts = [C.byte_words(t) for t, _ in rows]
    often: dict[str, Counter] = {y: Counter() for y in langs}
    for ws, (_, y) in zip(texts, rows, strict=True):
        often[y].update(set(ws))
    lexicon = {w.decode("utf-8", "replace").lower() for c in often.values() for w, n in c.most_common(300) if n >= 5}
    words = Words(lexicon)
    ids = [np.array([i for i in map(words.__getitem__, ws) if i >= 0], np.int64) for ws in texts]
    lengths = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    del texts, ids
    if not len(flat):
        return nothing
    feats, starts = words.rows()
    del words
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(feats))))
    size, y = len(langs), np.repeat([langs.index(v) for _, v in rows], lengths)
    w, cache = np.zeros((SPACE, size)), np.full((SPACE, size), 1e-8)

    def emit() -> np.ndarray:
        return np.stack([np.add.reduceat(w[feats, k], starts) for k in range(size)], 1)

    def climb(grad: np.ndarray, rate: float) -> None:
        g = np.stack([np.bincount(feats, grad[owner, k], SPACE) for k in range(size)], 1) - 1e-3 * w
        cache[:] += g * g
        w[:] += rate * g / np.sqrt(cache)

    def marginal(trans: np.ndarray, pairs: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        e = emit()
        for at, _, p, expected in forward_backward(lambda a, b: e[flat[a:b]], lengths, trans, pairs):
            yield at, at + len(p), p, expected

    counts = np.stack([np.bincount(flat, y == k, len(starts)) for k in range(size)], 1)
    for _ in range(rounds):
        e = emit()
        p = np.exp(e - e.max(1, keepdims=True))
        climb(counts - counts.sum(1, keepdims=True) * p / p.sum(1, keepdims=True), 0.3)
    stay = np.log(np.where(np.eye(size, dtype=bool), 0.99, 0.01 / max(1, size - 1)))
    for a, b, p, _ in marginal(stay, False):
        y[a:b] = np.where(p.max(1) > 0.99, p.argmax(1), y[a:b])  # switched stretches get their own label
    counts = np.stack([np.bincount(flat, y == k, len(starts)) for k in range(size)], 1)
    follow = np.ones(len(flat), bool)
    follow[np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]] = False
    seen = np.zeros((size, size))
    np.add.at(seen, (y[np.flatnonzero(follow) - 1], y[follow]), 1)
    trans = np.log((seen + 0.5) / (seen + 0.5).sum(1, keepdims=True))
    for _ in range(chain_rounds):
        got, expected = np.zeros_like(counts), np.zeros((size, size))
        for a, b, p, x in marginal(trans, True):
            got += np.stack([np.bincount(flat[a:b], p[:, k], len(starts)) for k in range(size)], 1)
            expected += x
        climb(counts - got, 0.1)
        trans += 0.5 * (seen - expected) / (seen.sum(1, keepdims=True) + 1)
    return {"langs": langs, "w": w.astype(np.float32), "trans": trans, "lexicon": lexicon}


def tagged(texts: list[str | None], model: dict, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, probabilities, lengths, places among all words) of stretches of words with letters, in order."""
    if len(words) > KEPT:
        words.forget()
    ids, sizes, at = [], [], []
    for t in texts:
        ws = C.byte_words(t)
        i = np.fromiter(map(words.__getitem__, ws), np.int64, len(ws))
        keep = np.flatnonzero(i >= 0)
        ids.append(i[keep].astype(np.int32))
        at.append(keep.astype(np.int32))
        sizes.append(np.fromiter(map(len, ws), np.int32, len(ws))[keep])
    lengths = np.array([len(i) for i in ids], np.int64)
    if not lengths.sum():
        return
    flat, sizes, at = np.concatenate(ids), np.concatenate(sizes), np.concatenate(at)

    known = words.emissions(model["w"])

    def emit(a: int, b: int) -> np.ndarray:
        return known[flat[a:b]].astype(float)

    ends = np.cumsum(lengths)
    for lo, first, p, _ in forward_backward(emit, lengths, model["trans"]):
        k, done = first, 0
        while done < len(p):  # a stretch holds whole texts or a part of one
            n = int(min(ends[k], lo + len(p)) - (lo + done))
            if n:
                yield k, p[done : done + n], sizes[lo + done : lo + done + n], at[lo + done : lo + done + n]
            done += n
            k += 1


def predicted(docs: DataFrame, model: dict, runs: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score; with runs also the stretches (first, last word, lang) of one language."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words, size = Words(m["lexicon"]), max(1, len(m["langs"]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                n = part.num_rows
                mass, spans = np.zeros((n, size)), [[] for _ in range(n)]
                for k, p, length, at in tagged(part.column("text").to_pylist(), m, words) if m["langs"] else ():
                    mass[k] += (p * length[:, None]).sum(0)
                    if runs:
                        best = p.argmax(1)
                        cut = np.flatnonzero(np.diff(best)) + 1
                        for a, b in zip([0, *cut], [*cut, len(best)], strict=True):
                            lang, last = m["langs"][int(best[a])], spans[k][-1] if spans[k] else None
                            if last and last["lang"] == lang:
                                last["last"] = int(at[b - 1])
                            else:
                                spans[k].append({"first": int(at[a]), "last": int(at[b - 1]), "lang": lang})
                total = mass.sum(1)
                lang = [m["langs"][int(v.argmax())] if s else "und" for v, s in zip(mass, total, strict=True)]
                score = np.where(total > 0, np.minimum(1.0, mass.max(1) / np.where(total > 0, total, 1.0)), 0.0)
                cols = [*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                names = [*kept, "lang_pred", "score"]
                if runs:
                    cols, names = [*cols, pa.array(spans, kind)], [*names, "runs"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = docs.drop("lang_pred", "score", "runs")
    kept = docs.columns if keep is None else keep
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double" + ", runs array<struct<first:int,last:int,lang:string>>" * runs)


def training_rows(docs: DataFrame, most_each: int = MOST_EACH, most: int = MOST_ROWS) -> list[tuple[str, str]]:
    """At most ``most_each`` training texts of each language and about ``most`` of all (one for each at least), those of least hash.

    What is hashed, counted and ranked are distinct (doc_id, text) pairs, so that ids which repeat crowd out neither their own language
    nor others. They are counted first, by sketches, so that only about four times as many as are wanted are ranked, however many there
    are. Bounded in bytes too.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (C.bucket_of(F.col("doc_id"), 4) != 2)).select("doc_id", "text", "lang")
    known = known.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row for each language
    if not counts:
        return []
    each = max(1, min(most_each, most // len(counts)))
    bars = [(r.lang, min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, 4 * each / max(1, r.n))))) for r in counts]
    bar = docs.sparkSession.createDataFrame(bars, "lang string, bar bigint")
    low = known.select("doc_id", "lang", "h").join(F.broadcast(bar), "lang").where("h <= bar").select("doc_id", "lang", "h").distinct()
    chosen = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= each)
    pairs = chosen.groupBy("doc_id", "h").agg(F.min("lang").alias("only"))
    rows = known.join(F.broadcast(pairs.select("doc_id", "h")), ["doc_id", "h"], "left_semi").select("doc_id", "text", "lang")
    return [(r.text, r.lang) for r in C.fetched(rows, pairs.groupBy("doc_id").agg(F.min("only").alias("only")), each * len(counts), ["lang"])]


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    out = predicted(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (C.bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
