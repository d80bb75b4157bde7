"""Keys seen so far on a stream, in bounded memory: blocked Bloom filters in state before an exact check, oldest keys forgotten first.

Keys are dealt to buckets by hash. A bucket's filters (``bits`` a key, in ``GENERATIONS`` of its capacity) come to the worker
with each micro-batch, and answer for most new keys; what they may have seen is looked up in the exact keys, which RocksDB
keeps on disk: a row each where a micro-batch brings few new ones, else packed in pages by hash, which come and go as a whole. So repeats are told exactly, and what must be in memory is a few bits for each key. When a bucket
has as many keys as its capacity, the oldest generation is dropped with its filter: keys go in the order of first sight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import ordered as O
from millrace.streaming.timed import use_rocksdb

#: Generations of a bucket's keys; bits of a filter's block, and set for each key.
GENERATIONS, BLOCK, SET = 10, 512, 7
#: New keys of a generation in one micro-batch from which they are packed; keys of a full page.
PACKED, PAGE = 256, 2048


class Bloom:
    """A blocked Bloom filter: all bits of a key lie in one block of 64 bytes."""

    def __init__(self, keys: int, bits: float, raw: bytes | None = None) -> None:
        blocks = max(1, -(-int(keys * bits) // BLOCK))
        self.bits = np.frombuffer(raw, np.uint8).copy() if raw else np.zeros(blocks * BLOCK // 8, np.uint8)

    def places(self, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
        """(keys, SET) positions of bits: the block by one hash, nine bits of the other for each place in it."""
        block = h0.astype(np.uint64) % np.uint64(len(self.bits) * 8 // BLOCK)
        inside = (h1.astype(np.uint64)[:, None] >> (np.arange(SET, dtype=np.uint64) * np.uint64(9))) & np.uint64(BLOCK - 1)
        return (block[:, None] * np.uint64(BLOCK) + inside).astype(np.int64)

    def may_hold(self, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
        return self.holds(self.places(h0, h1))

    def holds(self, at: np.ndarray) -> np.ndarray:
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def add(self, h0: np.ndarray, h1: np.ndarray) -> None:
        at = self.places(h0, h1).ravel()
        np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def among(keys: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Which of the keys (h0, h1) are rows of ``keys``: one sort of both."""
    n = len(keys)
    a, b = np.r_[keys[:, 0], h0], np.r_[keys[:, 1], h1]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    held = np.zeros(len(order), bool)
    held[run[:n]] = True
    return held[run[n:]]


class Seen(StatefulProcessor):
    """One bucket of keys."""

    def __init__(self, columns: list[str], order: str, capacity: int, bits: float) -> None:
        self.columns, self.order, self.bits = columns, order, bits
        self.each = max(1, capacity // GENERATIONS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filters = handle.getMapState("filters", "generation int", "bits binary, n int, packed int")
        self.keys = handle.getMapState("keys", "h0 long, h1 long", "generation int")
        self.pages = handle.getMapState("pages", "generation int, page int", "keys binary")

    def page_of(self, h1: np.ndarray) -> np.ndarray:
        return (h1.astype(np.uint64) % np.uint64(max(1, self.each // PAGE))).astype(np.int64)

    def page(self, generation: int, page: int) -> np.ndarray:
        at = (generation, page)
        return np.frombuffer(bytes(self.pages.getValue(at)[0]), np.int64).reshape(-1, 2) if self.pages.containsKey(at) else np.empty((0, 2), np.int64)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat([x.set_axis([*self.columns, "_h0", "_h1", "_bucket"], axis=1) for x in rows], ignore_index=True).sort_values(self.order, kind="stable")
        filters = {int(g[0]): [Bloom(self.each, self.bits, bytes(v[0])), int(v[1]), int(v[2])] for g, v in self.filters.iterator()}
        h0, h1 = new["_h0"].to_numpy(np.int64), new["_h1"].to_numpy(np.int64)
        again = new.duplicated(["_h0", "_h1"]).to_numpy()
        single, pages = np.zeros(len(new), bool), self.page_of(h1)
        at = Bloom(self.each, self.bits).places(h0, h1)
        for g, (bloom, n, packed) in filters.items():
            maybe = np.flatnonzero(bloom.holds(at) & ~again)
            if n > packed:
                single[maybe] = True
            if packed and len(maybe):
                held = np.concatenate([self.page(g, int(p)) for p in np.unique(pages[maybe])])
                again[maybe] = among(held, h0[maybe], h1[maybe])
        self.lookups = 0
        for i in np.flatnonzero(single & ~again):
            self.lookups += 1
            again[i] = self.keys.containsKey((int(h0[i]), int(h1[i])))
        self.remember(filters, h0[~again], h1[~again])
        out = new[self.columns].copy()
        out["_is_duplicate"] = again
        yield out

    def remember(self, filters: dict[int, list], h0: np.ndarray, h1: np.ndarray) -> None:
        at, changed = 0, set()
        while at < len(h0):
            g = max(filters, default=0)
            if g not in filters or filters[g][1] >= self.each:
                g += g in filters
                filters[g] = [Bloom(self.each, self.bits), 0, 0]
            n = min(self.each - filters[g][1], len(h0) - at)
            a, b = h0[at : at + n], h1[at : at + n]
            filters[g][0].add(a, b)
            if n >= PACKED:
                self.pack(g, a, b, filters[g][2] > 0)
                filters[g][2] += n
            else:
                for k in zip(a.tolist(), b.tolist(), strict=True):
                    self.keys.updateValue(k, (g,))
            filters[g][1] += n
            changed.add(g)
            at += n
            while len(filters) > GENERATIONS:
                self.forget(min(filters), filters)
        for g in changed & filters.keys():
            self.filters.updateValue((g,), (filters[g][0].bits.tobytes(), filters[g][1], filters[g][2]))

    def pack(self, generation: int, h0: np.ndarray, h1: np.ndarray, more: bool) -> None:
        """New keys go behind those that their pages hold."""
        pages = self.page_of(h1)
        order = np.argsort(pages, kind="stable")
        keys = np.stack([h0[order], h1[order]], axis=1)
        found, first = np.unique(pages[order], return_index=True)
        for p, own in zip(found.tolist(), np.split(keys, first[1:]), strict=True):
            self.pages.updateValue((generation, p), ((np.concatenate([self.page(generation, p), own]) if more else own).tobytes(),))

    def forget(self, generation: int, filters: dict[int, list]) -> None:
        _, n, packed = filters.pop(generation)
        if n > packed:
            for k in [k for k, v in self.keys.iterator() if v[0] == generation]:
                self.keys.removeKey(tuple(k))
        for p in range(max(1, self.each // PAGE) if packed else 0):
            if self.pages.containsKey((generation, p)):
                self.pages.removeKey((generation, p))
        if self.filters.containsKey((generation,)):
            self.filters.removeKey((generation,))

    def close(self) -> None:
        pass


def marked(df: DataFrame, keys: list[str], order: str, capacity: int = 100_000, buckets: int = 64, bits: float = 12.0) -> DataFrame:
    """A stream's rows with _is_duplicate: whether the key was seen before, in this micro-batch (in ``order``) or an earlier one.

    At most ``capacity`` keys are remembered, in equal shares of ``buckets``; each takes ``bits`` of a filter in memory and 16 bytes or a row on disk. Null
    keys are keys. Beyond the capacity the keys seen first are forgotten, a tenth at a time, and count as new again.
    """
    use_rocksdb(df.sparkSession)
    columns = df.columns
    h = O.marks([F.col(k) for k in keys], "h0", "h1")
    rows = df.select(*columns, *h).withColumn("bucket", F.pmod(F.col("h0"), F.lit(buckets)).cast("int"))
    schema = T.StructType([*df.schema.fields, T.StructField("_is_duplicate", T.BooleanType())])
    return rows.groupBy("bucket").transformWithStateInPandas(Seen(columns, order, max(GENERATIONS, capacity // buckets), bits), schema, "Append", "None")


def first_sight(df: DataFrame, keys: list[str], order: str, **bounds: float) -> DataFrame:
    """Only the rows whose key was not seen before."""
    return marked(df, keys, order, **bounds).where("NOT _is_duplicate").drop("_is_duplicate")
