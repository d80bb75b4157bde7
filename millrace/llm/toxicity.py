"""Toxicity: Levenshtein automata intersected with a lexicon trie, weighed by context windows.

The lexicon is learned from labelled texts: words, and stems that words start with,
that mark label 1. Its trie is intersected with Levenshtein automata (a swap of
neighbours counts as one edit): a state is a set of (trie node, edits, letter still due)
items, made when first reached, so that most words die after a few letters. Terms of four
letters or more and stems of five or more may be off by one edit, long words by two, unless the word
itself is common in texts with label 0. A hit counts by its term's weight and edits. Its context window
tells how it is used: within quotation marks, beside words of reporting, or plainly; beside words
that address a reader; and beside words that labelled rows mark for either label. Each kind of
use is a feature of its own, and a logistic curve, fitted on labelled rows that the lexicon of their
sums has not seen, learns what it weighs. A term is kept if Fisher's exact test marks it at a
false discovery rate, so the evidence asked for follows the number of labelled rows.

Defined cases: null and empty texts have no hits and score the curve's base value; texts, words and
quotations of any length are whole (a quotation ends at a blank line at latest); repeated rows score
alike; without labelled rows of both kinds scores are the share of label 1 (0 without any);
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Labelled rows taken; share of false terms among those kept; words in a context window on either side.
MOST_LABELLED, FALSE_RATE, WINDOW = 6000, 0.05, 8
STEMS = range(3, 9)
#: Least lengths of words for one and for two edits, and of stems for one; states kept at most.
ONE_EDIT, TWO_EDITS, STEM_EDIT, MOST_STATES = 4, 8, 5, 100_000
#: Where labelled rows show no misspelling of a term, an edit keeps this share of its weight; the texts that this prior is worth; the share below which such a match is none.
EDIT_KEEPS, EDIT_PRIOR, EDIT_LEAST = 0.8, 5.0, 0.25
# Words beside which a term is reported, not used; words that address a reader. What they weigh is learned.
REPORTING = {b"said", b"says", b"say", b"called", b"calls", b"quote", b"quoted", b"quoting", b"wrote", b"word", b"words", b"term", b"slur", b"insult", b"insults", b"sagte", b"wort", b"nannte", b"dit", b"mot", b"dijo", b"palabra"}
ADDRESS = {b"you", b"your", b"youre", b"du", b"dich", b"dein", b"ihr", b"tu", b"toi", b"vous", b"ton", b"usted", b"eres", b"ti"}
# Opening quotation marks and what closes them.
CLOSES = {k.encode(): v.encode() for k, v in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"))}
MARK = re.compile(b"|".join(re.escape(m) for m in sorted({*CLOSES, *CLOSES.values()})) + rb"|\n[ \t\r]*\n")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
N_FEATURES = 8


class Automaton:
    """The terms' trie within their edits, as a lazily built deterministic automaton over characters."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.terms = [(t, w, False) for t, w in words.items()] + [(t, w, True) for t, w in stems.items()]
        self.edits = [int(len(t) >= STEM_EDIT) if stem else (len(t) >= ONE_EDIT) + (len(t) >= TWO_EDITS) for t, _, stem in self.terms]
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.loose = [0]  # the most edits that a term below may have
        for k, (t, _, _) in enumerate(self.terms):
            node = 0
            self.loose[0] = max(self.loose[0], self.edits[k])
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.loose.append(0)
                node = self.child[node][c]
                self.loose[node] = max(self.loose[node], self.edits[k])
            self.ends[node].append(k)
        self.restart()

    def restart(self) -> None:
        self.sets: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.root = self.state({(0, 0, "")})

    def state(self, items: set) -> int:
        todo = [x for x in items if x[0] >= 0 and not x[2]]
        while todo:  # a letter of the term may be missing
            node, k, _ = todo.pop()
            for below in self.child[node].values():
                item = (below, k + 1, "")
                if k < self.loose[below] and item not in items:
                    items.add(item)
                    todo.append(item)
            items |= {(-1 - t, k, "") for t in self.ends[node] if self.terms[t][2] and k <= self.edits[t]}
        fewest: dict[tuple, int] = {}
        for node, k, due in items:
            fewest[node, due] = min(k, fewest.get((node, due), k))
        key = tuple(sorted((node, k, due) for (node, due), k in fewest.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def move(self, at: int, c: str) -> int:
        out = set()
        for node, k, due in self.sets[at]:
            if node < 0:  # a stem has matched: the rest of the word is free
                out.add((node, k, ""))
            elif due:  # the second letter of a swap
                if c == due:
                    out.add((node, k, ""))
            else:
                for d, below in self.child[node].items():
                    if d == c:
                        out.add((below, k, ""))
                    elif k < self.loose[below]:
                        out.add((below, k + 1, ""))
                        after = self.child[below].get(c)
                        if after is not None and k < self.loose[after]:
                            out.add((after, k + 1, d))
                if k < self.loose[node]:
                    out.add((node, k + 1, ""))
        to = self.moves[at][c] = self.state(out)
        return to

    def best(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the heaviest match with the fewest edits."""
        if len(self.sets) > MOST_STATES:
            self.restart()
        at, moves = self.root, self.moves
        for c in word:
            to = moves[at].get(c)
            at = self.move(at, c) if to is None else to
            if not self.sets[at]:
                return None
        found = []
        for node, k, due in self.sets[at]:
            if node < 0:
                found.append((k, -self.terms[-1 - node][1], -1 - node))
            elif not due:
                found += [(k, -self.terms[t][1], t) for t in self.ends[node] if k <= self.edits[t]]
        return (min(found)[2], min(found)[0]) if found else None


class Hits(dict):
    """word (bytes) -> (weight, edits, share, term), weight 0 for no hit; emptied when it holds many. An edited match counts by its share of the weight."""

    def __init__(self, model: dict):
        super().__init__()
        self.auto, self.clean, self.near, self.keeps = Automaton(model["words"], model["stems"]), model["clean"], model.get("near", {}), model.get("keeps", {})
        self.exact = {(t, stem): w for t, w, stem in self.auto.terms}
        self.lengths = sorted({len(t) for t, stem in self.exact if stem})

    def __missing__(self, raw: bytes) -> tuple[float, int, float, str]:
        if len(self) >= 300_000:
            self.clear()
        word = raw.decode("utf-8", "replace")
        self[raw] = 0.0, 0, 0.0, ""
        if word in self.clean:  # only without edits
            ways = [(word, False), *((word[:k], True) for k in self.lengths if k <= len(word))]
            if found := [(self.exact[t], t[0]) for t in ways if t in self.exact]:
                weight, term = max(found)
                self[raw] = weight, 0, 1.0, term
        elif (got := self.auto.best(word)) is not None:
            term, weight, _ = self.auto.terms[got[0]]
            share = self.keeps.get((term, got[1]), EDIT_KEEPS ** got[1])
            if not got[1] or share >= EDIT_LEAST:
                self[raw] = weight, got[1], share if got[1] else 1.0, term
        return self[raw]


def quotations(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans between matching quotation marks, merged and in order; one scan."""
    spans, due = [], {}
    for m in MARK.finditer(raw):
        mark = m.group()
        if mark in due:
            spans.append((due.pop(mark), m.end()))
        elif mark in CLOSES:
            due.setdefault(CLOSES[mark], m.start())
        elif mark[:1] == b"\n":
            due.clear()
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Hit(NamedTuple):
    word: bytes
    place: int
    weight: float
    edits: int
    quoted: bool
    reported: bool
    addressed: bool
    context: float
    share: float
    term: str


def hits_of(text: str, hits: Hits) -> list[Hit]:
    """The hits of a text, with their places among its words and what their context windows tell."""
    ws = C.byte_words(text)
    found = [(i, *v) for i, v in enumerate(map(hits.__getitem__, ws)) if v[0]]
    if not found:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = quotations(raw)
    starts = [m.start() for m in WORD.finditer(raw)] if spans else []
    opens = [a for a, _ in spans]
    out = []
    for i, v, k, share, term in found:
        at = bisect.bisect_right(opens, starts[i]) - 1 if spans else -1
        near = set(ws[max(0, i - WINDOW) : i]) | set(ws[i + 1 : i + WINDOW + 1])
        told = sum(hits.near.get(w, 0.0) for w in near) if hits.near else 0.0
        out.append(Hit(ws[i], i, v, k, at >= 0 and starts[i] < spans[at][1], bool(near & REPORTING), bool(near & ADDRESS), max(-3.0, min(3.0, told)), share, term))
    return out


def features(texts: list[str | None], hits: Hits) -> np.ndarray:
    """Sums of weights used, quoted, reported and addressed; the heaviest and distinct terms used; use by length; context."""
    out = np.zeros((len(texts), N_FEATURES))
    for k, text in enumerate(texts):
        if text and (found := hits_of(text, hits)):
            v = [h.weight * h.share for h in found]
            plain = [(h.word, x) for h, x in zip(found, v, strict=True) if not h.quoted and not h.reported]
            of = lambda test: np.log1p(sum(x for h, x in zip(found, v, strict=True) if test(h)))  # noqa: B023, E731
            total = sum(x for _, x in plain)
            out[k] = (
                np.log1p(total), of(lambda h: h.quoted), of(lambda h: h.reported and not h.quoted), of(lambda h: h.addressed and not h.quoted),
                max((x for _, x in plain), default=0.0), np.log1p(len({w for w, _ in plain})), total / (10 + len(text)) ** 0.5,
                sum(x * h.context for h, x in zip(found, v, strict=True)) / sum(v),
            )
    return out


@lru_cache(maxsize=1 << 18)
def by_chance(a: int, c: int, n1: int, n: int) -> float:
    """The probability that ``a`` or more of the ``c`` texts with a term are among the ``n1`` of label 1 (Fisher's exact test)."""
    ways = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    low, top = max(a, c - (n - n1)), min(c, n1)
    if low > top:
        return 0.0
    if a * n <= c * n1:  # no more than expected: the terms still rise
        return min(1.0, sum(math.exp(ways(n1, x) + ways(n - n1, c - x) - ways(n, c)) for x in range(low, top + 1)))
    term = total = math.exp(ways(n1, low) + ways(n - n1, c - low) - ways(n, c))
    for x in range(low, top):
        term *= (n1 - x) * (c - x) / ((x + 1) * (n - n1 - c + x + 1))
        total += term
        if term <= total * 1e-17:
            break
    return min(1.0, total)


def chance_cut(found: list[float], counts: Counter, n1: int, n: int, rate: float) -> float:
    """The largest probability of a kept term (Benjamini-Hochberg): ranked among the terms that occur often enough to be told (Tarone), or among all that were found if these are more."""
    least = sorted((by_chance(min(c, n1), c, n1, n), many) for c, many in counts.items())
    told, tests = 0, 1
    for p, many in least:
        if p * max(1, told + many) > rate:
            break
        told += many
        tests = told
    tests, cut = max(tests, len(found)), 0.0
    for k, p in enumerate(sorted(found), 1):
        if p <= rate * k / tests:
            cut = p
    return cut


def counted(rows: list[tuple[str, int]]) -> tuple[dict[int, Counter], Counter]:
    """In how many texts of either label each word and stem (after ^) stands, and how many texts there are."""
    seen = {0: Counter(), 1: Counter()}
    total = Counter(y for _, y in rows)
    for text, y in rows:
        ws = {w.decode("utf-8", "replace") for w in set(C.byte_words(text))}
        seen[y].update(ws)
        seen[y].update({f"^{w[:k]}" for w in ws for k in STEMS if len(w) > k})
    return seen, total


def without(whole: tuple[dict[int, Counter], Counter], part: tuple[dict[int, Counter], Counter]) -> tuple[dict[int, Counter], Counter]:
    """What is counted in the other parts; words of this one alone stay with zero."""
    seen, total = {y: c.copy() for y, c in whole[0].items()}, whole[1].copy()
    for y, c in part[0].items():
        seen[y].subtract(c)
    total.subtract(part[1])
    return seen, total


def lexicon(rows: list[tuple[str, int]], rate: float = FALSE_RATE) -> dict:
    return lexicon_of(*counted(rows), rate)


def lexicon_of(seen: dict[int, Counter], total: Counter, rate: float = FALSE_RATE) -> dict:
    """words and stems with their log odds, and the words common in texts with label 0."""
    n1, n0, n = total[1] + 1, total[0] + 1, total[0] + total[1]
    found = []
    for t, a in seen[1].items():
        if not a:
            continue
        b = seen[0][t]
        odds = np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0)
        if odds > np.log(6):
            found.append((by_chance(a, a + b, total[1], n), a, b, t, float(odds)))
    counts = Counter((seen[0] + seen[1]).values())
    cut = chance_cut([f[0] for f in found], counts, total[1], n, rate)
    ranked = []
    for p, a, b, t, odds in found:
        if p <= cut:
            g = 2 * (a * np.log(a * (n1 + n0) / ((a + b) * n1)) + (b * np.log(b * (n1 + n0) / ((a + b) * n0)) if b else 0.0))
            ranked.append((-g * (1.0 if t[0] == "^" else 1.05), -len(t), t, odds))  # a whole word before its stems
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for _, _, t, odds in sorted(ranked):
        bare = t.removeprefix("^")
        if any(bare.startswith(s) or s.startswith(bare) for s in stems) or (t[0] == "^" and any(w.startswith(bare) for w in words)):
            continue
        (stems if t[0] == "^" else words)[bare] = odds
    clean = {w for w, n in seen[0].items() if n >= 2 and w[0] != "^"}
    return {"words": words, "stems": stems, "clean": clean}


def contexts(rows: list[tuple[str, int]], model: dict, rate: float = FALSE_RATE) -> dict:
    """``model`` with near (log odds of words beside hits, by label) and keeps (what of its weight a term keeps at so many edits), from the labels' hits.

    Each (term, edits) starts from the prior and follows the texts whose label its edited forms meet, so that a long term that chance
    words resemble loses its edits and the others keep theirs, however many labels there are.
    """
    hits, seen, texts, edited = Hits(model), {0: Counter(), 1: Counter()}, Counter(), {0: Counter(), 1: Counter()}
    for text, y in rows:
        if not (found := hits_of(text, hits)):
            continue
        ws = C.byte_words(text)
        texts[y] += 1
        seen[y].update({w for h in found for w in (*ws[max(0, h.place - WINDOW) : h.place], *ws[h.place + 1 : h.place + WINDOW + 1]) if not hits[w][0]})
        edited[y].update({(h.term, h.edits) for h in found if h.edits})
    n, counts = texts[0] + texts[1], Counter((seen[0] + seen[1]).values())
    near = {}
    for y in (0, 1):
        found = [(by_chance(a, a + seen[1 - y][w], texts[y], n), w) for w, a in seen[y].items() if a * texts[1 - y] > 2 * seen[1 - y][w] * texts[y]]
        cut = chance_cut([p for p, _ in found], counts, texts[y], n, rate) if texts[0] and texts[1] else 0.0
        for p, w in found:
            if p <= cut:
                near[w] = float(np.log((seen[1][w] + 0.5) / (texts[1] + 1)) - np.log((seen[0][w] + 0.5) / (texts[0] + 1)))
    keeps = {t: (edited[1][t] + EDIT_KEEPS ** t[1] * EDIT_PRIOR) / (edited[1][t] + edited[0][t] + EDIT_PRIOR) for t in edited[0] | edited[1]}
    return model | {"near": near, "keeps": keeps}


def fit(rows: list[tuple[str, int]], parts: int = 3) -> dict:
    """Lexicon and contexts from all labelled rows; the curve from sums by those of the other parts."""
    each = [counted(rows[k::parts]) for k in range(parts)]
    whole = {y: sum((e[0][y] for e in each), Counter()) for y in (0, 1)}, sum((e[1] for e in each), Counter())
    model = contexts(rows, lexicon_of(*whole))
    y = np.array([v for _, v in rows], float)
    if len(set(y)) < 2:
        share = sum(v for _, v in rows) / len(rows) if rows else 0.0
        return model | {"w": [0.0] * N_FEATURES + [float(np.log((share + 1e-6) / (1 - share + 1e-6)))], "mean": [0.0] * N_FEATURES, "sd": [1.0] * N_FEATURES}
    x = np.zeros((len(rows), N_FEATURES))
    for k in range(parts):
        rest = [r for i, r in enumerate(rows) if i % parts != k]
        x[k::parts] = features([t for t, _ in rows[k::parts]], Hits(contexts(rest, lexicon_of(*without(whole, each[k])))))
    sd = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    return model | {"w": C.logistic((x - x.mean(0)) / sd, y).tolist(), "mean": x.mean(0).tolist(), "sd": sd.tolist()}


def score(docs: DataFrame, model: dict, spans: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted; with spans also hits (word, place, weight, edits, quoted, reported)."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("place", pa.int32()), ("weight", pa.float64()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("reported", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        hits = Hits(m)
        w, mean, sd = (np.array(m[k]) for k in ("w", "mean", "sd"))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column("text").to_pylist()
                p = 1 / (1 + np.exp(-np.clip(((features(texts, hits) - mean) / sd) @ w[:-1] + w[-1], -30, 30)))
                cols = [*(part.column(c) for c in kept), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype("int32"))]
                names = [*kept, "score", "predicted"]
                if spans:
                    cols.append(pa.array([[{"word": h.word.decode("utf-8", "replace"), "place": h.place, "weight": h.weight, "edits": h.edits, "quoted": h.quoted, "reported": h.reported} for h in hits_of(t, hits)] if t else [] for t in texts], kind))
                    names.append("hits")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = docs.drop("score", "predicted", "hits")
    kept = docs.columns if keep is None else keep
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int" + ", hits array<struct<word:string,place:int,weight:double,edits:int,quoted:boolean,reported:boolean>>" * spans)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(C.labelled_sample(docs, C.table(spark, sf_dir, "labels"), "toxic", 5, 0, MOST_LABELLED))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", (C.bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
