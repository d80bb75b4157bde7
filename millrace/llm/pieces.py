"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a path through the lattice of its pieces. For a unigram model a path's
weight is the sum of its scores. For a BPE model a path is admitted (0) or not (minus
infinity): merging yields a sequence of pieces if and only if each of its pieces merges to
itself and each pair of neighbours merges to just that pair, so exactly one path is
admitted, the library's own. Both are the same max-plus computation.

A giant text is cut into chunks of CHUNK characters wherever that falls. A state at a cut
is a piece that covers the character before it; a chunk's transfer matrix holds the best
weight from each state at its left cut to each at its right cut. A document's matrices
are multiplied as a tree of FAN-wide ranges, each range a group of its own, which fixes the state at
every cut from the top downwards; then each chunk is backtraced by itself. Between places that no piece of the model can span (before a space,
mostly) a chunk's inside is independent of its cuts, so equal segments are solved once.

Models: byte fallback or unknown pieces, identity normalisation with escaped white space
and an optional dummy prefix; others are refused. Defined cases: null and empty texts
have no ids; U+2581 in a text decodes to a space, as in the library; a text of any length is
whole; repeated rows encode alike; null ids decode to null, ids of control pieces to nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import re
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C

SPACE, CHUNK, KNOWN, MIXED = "▁", 16_384, 500_000, 16_384
#: Matrices of one text that are multiplied in one group; bytes of giant texts that a task slices at once.
FAN = 256
#: Rows of texts, and of chunks, that are Python objects in a worker at once, however many a batch has.
TEXTS, CHUNKS = 256, 32
NONE = -np.inf


codecs.register_error("millrace_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def any_of(chars: Iterable[str]) -> str:
    """A pattern of one of these characters."""
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


class Model:
    """Pieces of a SentencePiece model and their lattice."""

    def __init__(self, raw: bytes, kind: str = "auto"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with escaped white space is supported")
        self.kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type] if kind == "auto" else kind
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.alone = {p: (i,) for p, i in self.ids.items()}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        self.pairs = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.closed = not any(p[1:] == SPACE and p[0] != SPACE for p in self.pairs)
        often = Counter(c for p in self.pairs for c in p)
        # Rare characters are not likely to be joined to their neighbours; where none stands, a segment is solved before it is cut.
        common = {c for c, n in often.items() if 4 * n >= max(often.values(), default=0)} | {" ", SPACE}
        self.rare = re.compile("[^" + any_of(common)[1:])
        self.segment = re.compile(self.cutting() if self.closed else r"(?s).+")
        self.trie: dict[str, list] = {}  # character -> [the same below it, the pieces that end there or before, longest first]
        for p in sorted(self.ids, key=len):
            if self.kind == "bpe" and self.merged(p) != [p]:
                continue  # merging never yields it
            below, found = self.trie, (p[0],)
            for c in p:
                node = below.setdefault(c, [{}, found])
                below, found = node
            if len(p) > 1:
                node[1] = (p, *found)
        back = {i: b for b, i in self.bytes.items()}
        special = {i: " ⁇ ".encode() if p.type == 2 else b"" for i, p in enumerate(proto.pieces) if p.type in (2, 3)}  # as the library shows them
        self.raw = [bytes([back[i]]) if i in back else special.get(i, n.replace(SPACE, " ").encode()) for i, n in enumerate(self.names)]
        self.shown: pa.Array | None = None  # the same for Arrow, once it is asked for
        self.leading = {i for p, i in self.ids.items() if p[0] == SPACE}
        self.next: dict[str, dict[str, bool]] = {}
        self.pairs_known = 0
        self.code = "H" if len(self.names) <= 1 << 16 else "I"
        self.mixed: dict[str, bytes] = {}  # the same for the latest segments with free places inside, MIXED at most
        self.solved: dict[str, bytes] = {}  # stretch, with plain spaces (a byte a character in Latin texts) -> its ids as an array of self.code

    def free(self, a: str, b: str) -> bool:
        """Whether no piece spans the place between these two characters."""
        return a + b not in self.pairs

    def cutting(self) -> str:
        """A pattern that cuts a text at free places only: runs of characters that pieces connect (letters, marks, ...) with the spaces before them, single characters else."""
        group: dict[str, set[str]] = {}
        for a, b in (p for p in self.pairs if SPACE not in p):
            one = group.setdefault(a, {a}) | group.setdefault(b, {b})
            group.update(dict.fromkeys(one, one))
        runs = sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), min(g)))
        spaced = {p[1] for p in self.pairs if p[0] == SPACE} - {SPACE, *group}
        found = [*(f"{any_of(g)}+" for g in runs), *([any_of(spaced)] if spaced else [])]
        return (f"[ {SPACE}]*(?:{'|'.join(found)})|" if found else "") + f"[ {SPACE}]+|(?s:.)"

    def merged(self, s: str) -> list[str]:
        """The merges of a BPE model on a short string."""
        score, parts = self.scores.get, list(s)
        gains = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > NONE:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], NONE)
        return parts

    def weight(self, before: str, piece: str) -> float:
        """The weight of ``piece`` after ``before`` ("" at the start)."""
        if self.kind == "unigram":
            return self.scores.get(piece, self.floor)
        if not before:
            return 0.0
        after = self.next.get(before)
        if after is None:
            after = self.next[before] = {}
        known = after.get(piece)
        if known is None:
            if before[-1] + piece[0] not in self.pairs:
                return 0.0
            if self.pairs_known >= KNOWN:
                self.next, self.pairs_known, after = {}, 0, {}
            self.pairs_known += 1
            known = after[piece] = self.merged(before + piece) == [before, piece]
        return 0.0 if known else NONE

    def arcs(self, text: str, at: int) -> tuple[str, ...]:
        """Pieces that start here, longest first; a character that is no piece stands for itself."""
        found, below = None, self.trie
        for c in text[at : at + self.longest]:
            node = below.get(c)
            if node is None:
                break
            below, found = node
        return found or (text[at],)

    def transfer(self, text: str, lo: int, hi: int, starts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, dict]:
        """Best weights from each start state to each state at ``hi``, and the way back.

        A state (a, b) is the piece text[a:b]; starts end at or after ``lo``; states at ``hi``
        start before it and end there or later, or at the end of ``text`` at latest.
        """
        reach: dict[tuple[int, int], np.ndarray] = {}
        back: dict[tuple[int, int], list] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        eye = np.where(np.eye(len(starts), dtype=bool), 0.0, NONE)
        for k, s in enumerate(starts):
            reach[s] = eye[k]
            ends.setdefault(s[1], []).append(s)
        done = {s for s in starts if s[1] >= hi}
        for at in range(lo, hi):
            if at not in ends:
                continue
            live = ends[at]
            for p in self.arcs(text, at):
                state, best, froms = (at, at + len(p)), None, None
                for s in live:
                    w = self.weight(text[s[0] : s[1]], p)
                    if w > NONE:
                        v = reach[s] + w
                        if best is None:
                            best, froms = v, np.where(v > NONE, ends[at].index(s), -1)
                        else:
                            froms = np.where(v > best, live.index(s), froms)
                            best = np.maximum(best, v)
                if best is not None:
                    reach[state], back[state] = best, (at, froms)
                    ends.setdefault(state[1], []).append(state)
                    if state[1] >= hi:
                        done.add(state)
        last = sorted(done)
        return last, np.stack([reach[s] for s in last], 1) if last else np.zeros((len(starts), 0)), {"back": back, "ends": ends}

    def path(self, way: dict, start: int, starts: list, last: tuple[int, int]) -> list[tuple[int, int]]:
        """The pieces after the start state, up to and with ``last``."""
        out, state = [], last
        while state not in starts:
            out.append(state)
            at, froms = way["back"][state]
            state = way["ends"][at][froms[start]]
        return out[::-1]

    def of(self, piece: str) -> tuple[int, ...]:
        known = self.alone.get(piece)
        if known is not None:
            return known
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def solve(self, seg: str) -> list[str]:
        """The pieces of a segment that no piece crosses the ends of; the first path found, longest pieces first, is the only one in a BPE model."""
        if self.kind == "unigram":
            last, w, way = self.transfer(seg, 0, len(seg), [(0, 0)])
            ends = [k for k, s in enumerate(last) if s[1] == len(seg)]
            best = max(ends, key=lambda k: w[0, k])
            return [seg[a:b] for a, b in self.path(way, 0, [(0, 0)], last[best])]
        arcs, after, weight, n = self.arcs, self.next, self.weight, len(seg)
        before, at, rest, stack, dead = "", 0, iter(arcs(seg, 0)), [], set()
        while True:
            known = after.get(before) or {}
            for p in rest:
                fine = known.get(p)
                if fine is None:
                    fine = weight(before, p) == 0.0
                if fine and (not dead or (at, p) not in dead):
                    stack.append((before, at, rest))
                    before, at = p, at + len(p)
                    if at == n:
                        return [*[x[0] for x in stack[1:]], p]
                    rest = iter(arcs(seg, at))
                    break
            else:
                dead.add((at - len(before), before))
                before, at, rest = stack.pop()

    def __getstate__(self):
        raise TypeError("send the model's bytes instead")

    def packed(self, text: str) -> bytes:
        """The ids of a text whose ends no piece crosses, as an array of self.code."""
        known, mixed, fresh = self.solved.get, self.mixed.get, self.fresh
        return b"".join([known(seg) or mixed(seg) or fresh(seg) for seg in self.segment.findall(text.replace(SPACE, " "))])

    def unpacked(self, ids: bytes) -> list[int]:
        return memoryview(ids).cast(self.code).tolist()

    def inside(self, text: str) -> list[int]:
        """The ids of a text whose ends no piece crosses."""
        return self.unpacked(self.packed(text))

    def fresh(self, seg: str) -> bytes:
        """The ids of a segment that is not known as a whole: its stretches between free places are solved, each of them once.

        Among common characters most places are not free; as pieces hold no free place, a segment of only them is cut after it is solved.
        """
        full, pairs = seg.replace(" ", SPACE), self.pairs
        if not self.rare.search(seg):
            found = self.solve(full)
            if all([p[-1] + q[0] in pairs for p, q in zip(found, found[1:], strict=False)]):
                return self.keep(self.solved, seg, self.numbers(found), KNOWN)
        cuts = [i for i in range(1, len(full)) if full[i - 1 : i + 1] not in pairs]
        got, known = [], self.solved.get
        for a, b in zip([0, *cuts], [*cuts, len(seg)], strict=True):
            part = seg[a:b]
            got.append(known(part) or self.keep(self.solved, part, self.numbers(self.solve(full[a:b])), KNOWN))
        return self.keep(self.mixed, seg, b"".join(got), MIXED) if cuts else got[0]

    def numbers(self, pieces: list[str]) -> bytes:
        """Their ids, packed."""
        return array(self.code, [i for p in pieces for i in self.of(p)]).tobytes()

    def keep(self, memory: dict[str, bytes], seg: str, ids: bytes, most: int) -> bytes:
        if len(seg) <= 64:
            if len(memory) >= most:
                memory.clear()
            memory[seg] = ids
        return ids

    def forget(self) -> None:
        self.solved.clear()
        self.mixed.clear()

    def encode(self, text: str | None) -> list[int]:
        return self.inside((self.prefix + text).replace(" ", SPACE)) if text else []

    def listed(self, many: list[bytes]) -> tuple[pa.ListArray, list[bytes]]:
        """Packed ids of several texts as lists of Arrow, and the bytes that those of each text show."""
        if self.shown is None:
            self.shown = pa.array(self.raw, pa.large_binary())
        ids = pa.array(np.frombuffer(b"".join(many), self.code).astype(np.int32))
        ends = np.cumsum([0, *(len(x) // array(self.code).itemsize for x in many)])
        _, offsets, data = self.shown.take(ids).buffers()
        at = np.frombuffer(offsets, np.int64)[ends].tolist()
        data = memoryview(data or b"")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def returns(self, ids: bytes, shown: bytes, want: str, first: bool = True) -> bool:
        """Whether packed ids, which show these bytes, decode to what is wanted: a text with its prefix's space, or a later part of one (not ``first``).

        Most do byte for byte; the others are decoded.
        """
        opened = not first or not self.prefix or int.from_bytes(ids[: array(self.code).itemsize], sys.byteorder) in self.leading
        if opened and SPACE not in want and shown == want.encode():
            return True
        if first:
            return self.prefix.replace(SPACE, " ") + self.decode(self.unpacked(ids)) == want
        return self.decode([self.ids.get(SPACE, 0), *self.unpacked(ids)]) == want

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "millrace_each_byte").replace(SPACE, " ")
        first = next((i for i in ids if self.raw[i]), None)  # control pieces show nothing
        return text[1:] if self.prefix and first in self.leading else text

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The pieces that cover the character before ``cut``."""
        return [(a, a + len(p)) for a in range(max(0, cut - self.longest), cut) for p in self.arcs(text, a) if a + len(p) >= cut]

    def near(self, text: str, lo: int, hi: int, step: int) -> int | None:
        """The first place from ``lo`` towards ``hi`` that no piece spans."""
        return next((i for i in range(lo, hi, step) if 0 < i < len(text) and self.free(text[i - 1], text[i])), None)

    def parts(self, text: str, lo: int, hi: int, starts: list[tuple[int, int]]) -> tuple:
        """A chunk as head, inside and tail: transfers at both sides of its outermost free places, or one for all."""
        most = max([lo, *(s[1] for s in starts)])
        a = lo if starts == [(lo, lo)] else self.near(text, most, hi, 1)
        b = self.near(text, hi, (a or lo), -1) if hi < len(text) else None
        if hi == len(text):
            b = hi
        if a is None or b is None or b < a:
            return self.transfer(text, lo, hi, starts), None, None, a, b
        head = self.transfer(text, lo, a, starts) if a > lo or starts != [(lo, lo)] else None
        tail = self.transfer(text, b, hi, [(b, b)]) if b < hi else None
        return None, head, tail, a, b

    def chunk(self, text: str, lo: int, hi: int, first: bool) -> tuple[list, list, np.ndarray]:
        """The states at both cuts (relative to them) and the transfer matrix between."""
        starts = [(lo, lo)] if first else self.states(text, lo)
        whole, head, tail, a, b = self.parts(text, lo, hi, starts)
        goals = self.states(text, hi)
        if whole:
            last, w = whole[0], whole[1]
        else:
            left = np.zeros((1, 1)) if head is None else np.max(head[1][:, [k for k, s in enumerate(head[0]) if s[1] == a]], axis=1, initial=NONE)[:, None]
            if a < b and self.kind == "unigram":
                left = left + self.total(text[a:b])
            if tail is not None:
                last, w = tail[0], left + tail[1]
            elif a < b:  # the cut itself is free: one piece ends there, whatever came in
                last, w = [self.ending(text, a, b)], left
            else:
                last, w = head[0], head[1]
        matrix = np.full((len(starts), len(goals)), NONE)
        for k, s in enumerate(last):
            if s in goals:
                matrix[:, goals.index(s)] = w[:, k]
        return [(s[0] - lo, s[1] - lo) for s in starts], [(s[0] - hi, s[1] - hi) for s in goals], matrix

    def ending(self, text: str, a: int, b: int) -> tuple[int, int]:
        """The last piece of the stretch between two free places."""
        at = max(a, self.near(text, b - 1, a, -1) or a)
        last, w, way = self.transfer(text, at, b, [(at, at)])
        ends = [k for k, s in enumerate(last) if s[1] == b]
        return last[max(ends, key=lambda k: w[0, k])]

    def total(self, text: str) -> float:
        return sum(self.scores.get(self.names[i], self.floor) for i in self.inside(text)) if not self.bytes else sum(self.best(s) for s in self.segment.findall(text))

    def best(self, seg: str) -> float:
        last, w, _ = self.transfer(seg, 0, len(seg), [(0, 0)])
        return max(w[0, k] for k, s in enumerate(last) if s[1] == len(seg))

    def backtrace(self, text: str, lo: int, hi: int, start: tuple[int, int], goal: tuple[int, int]) -> list[int]:
        """The ids of the pieces after state ``start`` up to and with state ``goal``."""
        return self.unpacked(self.traced(text, lo, hi, start, goal))

    def traced(self, text: str, lo: int, hi: int, start: tuple[int, int], goal: tuple[int, int]) -> bytes:
        """The same, packed."""
        whole, head, tail, a, b = self.parts(text, lo, hi, [start])
        ids = lambda spans: array(self.code, [i for x, y in spans for i in self.of(text[x:y])]).tobytes()
        if whole:
            return ids(self.path(whole[2], 0, [start], goal))
        out = b""
        if head is not None:
            ends = [s for s in head[0] if s[1] == a]
            w = [head[1][0, head[0].index(s)] for s in ends]
            if tail is None and a == b:
                return ids(self.path(head[2], 0, [start], goal))
            out += ids(self.path(head[2], 0, [start], ends[int(np.argmax(w))]))
        out += self.packed(text[a:b])
        return out + (ids(self.path(tail[2], 0, [(b, b)], goal)) if tail is not None else b"")


def loaded(raw: bytes, kind: str) -> Model:
    """The model, once for each Python worker: the pairs it knows serve the worker's later tasks too, solved segments only their own."""
    return C.held((raw, kind), lambda: Model(raw, kind))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two transfer matrices."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=NONE)


def scan(mats: list[np.ndarray], first: int | None = None, last: int | None = None) -> tuple[list[int], np.ndarray]:
    """The state at each cut on the best path (from ``first`` to ``last`` where they are given) and the product of all, combined as a tree."""
    n = len(mats)

    def build(lo: int, hi: int):
        if hi - lo == 1:
            return (mats[lo], None, None)
        mid = (lo + hi) // 2
        x, y = build(lo, mid), build(mid, hi)
        return (product(x[0], y[0]), x, y)

    root = build(0, n)
    chosen = [0 if first is None else first] * (n + 1)
    chosen[n] = int(np.argmax(root[0][chosen[0]])) if last is None else last

    def choose(node, lo: int, hi: int) -> None:
        if node[1] is not None:
            mid = (lo + hi) // 2
            chosen[mid] = int(np.argmax(node[1][0][chosen[lo]] + node[2][0][:, chosen[hi]]))
            choose(node[1], lo, mid)
            choose(node[2], mid, hi)

    choose(root, 0, n)
    return chosen, root[0]


MATRIX = "row bigint, at bigint, starts array<int>, goals array<int>, w array<double>"
STATES = "row bigint, at bigint, a0 int, a1 int, b0 int, b1 int"


def matrices_of(pdf: pd.DataFrame) -> tuple[list, list, list]:
    starts, goals = ([np.array(x).reshape(-1, 2) for x in pdf[c]] for c in ("starts", "goals"))
    return starts, goals, [np.array(w).reshape(len(s), len(g)) for w, s, g in zip(pdf["w"], starts, goals, strict=True)]


def multiplied(pdf: pd.DataFrame, fan: int) -> pd.DataFrame:
    """The product of one range's matrices."""
    pdf = pdf.sort_values("at")
    starts, goals, mats = matrices_of(pdf)
    whole = scan(mats)[1]
    return pd.DataFrame({"row": pdf["row"].iloc[:1], "at": pdf["at"].iloc[:1] // fan, "starts": [starts[0].ravel()], "goals": [goals[-1].ravel()], "w": [whole.ravel()]})


def stated(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at both cuts of each matrix of one range, whose own ends (a0, a1, b0, b1) are known below the top."""
    pdf = pdf.sort_values("at")
    starts, goals, mats = matrices_of(pdf)
    first = last = None
    if "a0" in pdf:
        first = starts[0].tolist().index([pdf["a0"].iloc[0], pdf["a1"].iloc[0]])
        last = goals[-1].tolist().index([pdf["b0"].iloc[0], pdf["b1"].iloc[0]])
    picked, _ = scan(mats, first, last)
    a = [s[i] for s, i in zip(starts, picked[:-1], strict=True)]
    b = [g[i] for g, i in zip(goals, picked[1:], strict=True)]
    return pd.DataFrame({"row": pdf["row"], "at": pdf["at"], "a0": [x[0] for x in a], "a1": [x[1] for x in a], "b0": [x[0] for x in b], "b1": [x[1] for x in b]})


def states_of(mats: DataFrame, fan: int = FAN) -> DataFrame:
    """STATES of MATRIX rows, numbered 0, 1, ... in each text: products of ranges upwards, states downwards.

    Rows are dealt by text and range over as many tasks as a shuffle has, however few bytes they are: it is their products that take time.
    """
    tasks = int(mats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = mats.agg(F.max("at")).first()[0]
    levels = [mats]
    while longest is not None and longest >= fan:
        up = levels[-1].withColumn("range", F.floor(F.col("at") / fan)).repartition(tasks, "row", "range").groupBy("row", "range")
        levels.append(C.written(up.applyInPandas(lambda pdf: multiplied(pdf, fan), MATRIX), "pieces-products"))
        longest //= fan
    known = levels[-1].repartition(tasks, "row").groupBy("row").applyInPandas(stated, STATES)
    for below in levels[-2::-1]:
        ends = known.withColumnRenamed("at", "range")
        ranged = below.withColumn("range", F.floor(F.col("at") / fan)).join(ends, ["row", "range"])
        known = ranged.repartition(tasks, "row", "range").groupBy("row", "range").applyInPandas(stated, STATES)
    return known


def solving(run: Callable[[Iterator[pa.RecordBatch], Model], Iterator[pa.RecordBatch]], sent: Broadcast, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with the worker's model; the segments that a task has solved go with it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value, kind)
        try:
            yield from run(batches, model)
        finally:
            model.forget()

    return C.thrifty(whole, holds=True)


def encoded(docs: DataFrame, raw: bytes, keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, kind: str = "auto", fan: int = FAN) -> DataFrame:
    """keep columns, ids (array<int>) and round_trip (decoding gives the text) of every document."""
    spark = docs.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(raw)
    model = Model(raw, kind)
    edge, prefix, ahead = model.longest, model.prefix, model.prefix.replace(SPACE, " ")
    names = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True)]
    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    giant = F.length(F.coalesce("text", F.lit(""))) > chunk

    def small(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TEXTS):
            texts = [t or "" for t in part.column("text").to_pylist()]
            codes = [m.packed(m.prefix + t) if t else b"" for t in texts]
            ids, shown = m.listed(codes)
            ok = [not t or m.returns(c, s, ahead + t) for c, s, t in zip(codes, shown, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), ids, pa.array(ok)], names=[*names, "ids", "round_trip"])

    short = docs.where(~giant).select(*kept, "text").mapInArrow(solving(small, sent, kind), f"{types}, ids array<int>, round_trip boolean")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("row", "lo", "left", "size", "body")
        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time, sliced in one pass
                part = batch.slice(k, 1)
                full = (prefix + part.column("text")[0].as_py()).replace(" ", SPACE)
                lows = range(0, len(full), chunk)
                row = part.column("row")[0].as_py()
                out = [(row, lo, lo - max(lo - 2 * edge, 0), min(chunk, len(full) - lo), full[max(lo - 2 * edge, 0) : lo + chunk + 2 * edge]) for lo in lows]
                kept_ = [pa.array([part.column(n)[0].as_py()] * len(out), part.schema.field(n).type) for n in names]
                cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*kept_, *cols], names=[*names, *fields])

    giants = docs.where(giant).select(F.monotonically_increasing_id().alias("row"), *kept, "text")
    cut = C.written(giants.mapInArrow(C.thrifty(slices, holds=True), f"{types}, row bigint, lo bigint, left int, size int, body string"), "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, CHUNKS):
            out = []
            for r in batch.to_pylist():
                starts, goals, w = m.chunk(r["body"], r["left"], r["left"] + r["size"], r["lo"] == 0)
                out.append((r["row"], r["lo"] // chunk, [x for s in starts for x in s], [x for s in goals for x in s], w.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())))], names=["row", "at", "starts", "goals", "w"])

    mats = C.written(cut.select("row", "lo", "left", "size", "body").mapInArrow(solving(matrices, sent, kind), MATRIX), "pieces-matrices")
    states = states_of(mats, fan).withColumn("lo", F.col("at") * chunk)

    def trace(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, CHUNKS):
            codes, wanted = [], []
            for r in batch.to_pylist():
                lo, hi = r["left"], r["left"] + r["size"]
                start, goal = (lo + r["a0"], lo + r["a1"]), (hi + r["b0"], hi + r["b1"])
                codes.append(m.traced(r["body"], lo, hi, start, goal))
                wanted.append((r["body"][start[1] : goal[1]].replace(SPACE, " "), r["lo"] == 0))
            ids, shown = m.listed(codes)
            ok = [m.returns(c, s, *w) for c, s, w in zip(codes, shown, wanted, strict=True)]
            keys = [batch.column(n) for n in ("row", "lo", *names)]
            yield pa.RecordBatch.from_arrays([*keys, ids, pa.array(ok)], names=["row", "lo", *names, "ids", "ok"])

    traced = cut.join(states.drop("at"), ["row", "lo"]).select("row", "lo", *names, "left", "size", "body", "a0", "a1", "b0", "b1").mapInArrow(solving(trace, sent, kind), f"row bigint, lo bigint, {types}, ids array<int>, ok boolean")
    joined = traced.groupBy("row").agg(*[F.first(n).alias(n) for n in names], F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "ids"))), lambda x: x["ids"])).alias("ids"), F.min("ok").alias("round_trip"))
    out = short.unionByName(joined.select(*names, "ids", "round_trip"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids", "round_trip")


def decoded(df: DataFrame, raw: bytes, kind: str = "auto", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (all but ids by default) with text: what its ids (array<int>) decode to, as in the library."""
    spark = df.sparkSession
    C.ship(spark)
    sent = spark.sparkContext.broadcast(raw)
    keep = tuple(c for c in df.columns if c not in ("ids", "text")) if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    types = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, TEXTS):
            texts = [None if i is None else m.decode(i) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    out = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "ids").mapInArrow(solving(run, sent, kind), f"{types}{', ' if names else ''}text string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read by the driver and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(C.table(spark, sf_dir, "documents"), model_bytes())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip")
