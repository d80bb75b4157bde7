"""Ordered streams: the processor's arithmetic against plain Python (whole streams are held against SQL in the queries)."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from millrace.streaming import seen, timed


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Map:
    def __init__(self):
        self.d = {}

    def iterator(self):
        return iter(self.d.items())

    def updateValue(self, k, v):
        self.d[k] = v

    def clear(self):
        self.d = {}


@pytest.mark.parametrize("sizes", [[60], [1, 1, 5, 20, 33], [1] * 60])
def test_released_rows_continue_where_the_last_release_ended(sizes):
    names = {f"a_{f}": f for f in timed.FUNCTIONS}
    p = timed.HeldAggregates(["x", "i"], "i", T.StructType(), "x", names, None, 3)
    p.sums, p.counts = Value(), Map()
    rng = random.Random(2)
    x = [rng.choice([None, float(rng.randrange(6)), rng.gauss(0, 9)]) for _ in range(60)]
    at, seen = 0, []
    for n in sizes:
        rows = pd.DataFrame({"x": x[at : at + n], "i": range(at, at + n)})
        out = p.released("k", rows)
        for k in range(n):
            v, r = x[at + k], out.iloc[k]
            if v is None:
                assert all(pd.isna(r[c]) for c in names)
                continue
            seen.append(v)
            s, m = sorted(seen), len(seen)
            top = sorted(Counter(seen).items(), key=lambda c: (-c[1], seen.index(c[0])))[:3]
            want = {"count": m, "sum": sum(seen), "mean": sum(seen) / m, "min": s[0], "max": s[-1], "std": float(np.std(seen)), "var": float(np.var(seen)), "first": seen[0], "last": v, "median": float(np.median(seen)), "unique": len(set(seen))}
            want |= {q: s[min(math.floor(m * share), m - 1)] for q, share in timed.O.PERCENTILES.items()}
            assert {f: float(r[f"a_{f}"]) for f in want} == pytest.approx(want, abs=1e-6)
            assert r["a_top_k"] == ",".join(f"{u:g}:{c}" for u, c in top)
        at += n


def test_unknown_functions_are_refused(spark):
    with pytest.raises(ValueError, match="no ordered form"):
        timed.in_order(spark.range(1).selectExpr("id g", "id x", "current_timestamp() t", "id o"), ["g"], "x", "t", "o", "a", ["rate"], 5)


class Handle:
    """A key's timers and maps; counts what goes to the state."""

    def __init__(self):
        self.timers, self.maps = set(), {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Counted())

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class Counted(Map):
    calls = 0

    def exists(self):
        return bool(self.d)

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.d[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self.d[k]


class Passed:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):
        return self.t


@pytest.mark.parametrize("at_once", [200_000, 100])
def test_waiting_rows_come_out_once_and_in_order(monkeypatch, at_once):
    """Rows wait packed: the state is called for micro-batches and hours of event time, not for rows."""
    monkeypatch.setattr(timed, "RELEASED", at_once)
    p, rng = timed.Held(["i", "x"], "i", T.StructType()), random.Random(4)
    p.init(Handle())
    given, out, late, passed = 0, [], [], 0
    for k in range(6):
        n = 2000
        rows = pd.DataFrame({"i": range(given, given + n), "x": [rng.choice([None, "a"]) for _ in range(n)], "at": [rng.randrange(k * 10, k * 10 + 30) * 720_000 + rng.randrange(9) for _ in range(n)], "tick": False, "mark": None})
        given += n
        late += [r for f in p.handleInputRows("k", iter([rows]), Passed(passed)) for r in f["i"]]
        passed = k * 10 * 720_000 + 4
        due = [t for t in p.handle.listTimers() if t <= passed]
        for t in due:
            p.handle.deleteTimer(t)
        if due:
            out += [(r.x, r.i) for f in p.handleExpiredTimer("k", Passed(passed), None) for r in f.itertuples()]
    rest = [r for f in p.handleExpiredTimer("k", Passed(1 << 60), None) for r in f["i"]]
    assert sorted([*late, *[i for _, i in out], *rest]) == list(range(given)) and out and {x for x, _ in out} == {None, "a"}
    assert not p.slots.d and not p.waiting.d
    assert p.slots.calls + p.waiting.calls < 400


class Keyed(Map):
    def containsKey(self, k):
        return k in self.d

    def removeKey(self, k):
        del self.d[k]


@pytest.mark.parametrize(("bits", "capacity"), [(12.0, 10_000), (0.5, 10_000), (12.0, 100)])
def test_seen_keys_are_exact_within_their_capacity(bits, capacity):
    """Filters that are far too small cost lookups, not truth; beyond the capacity the oldest tenth goes first."""
    p = seen.Seen(["k", "i"], "i", capacity, bits)
    p.filters, p.keys = Keyed(), Keyed()
    rng = np.random.default_rng(3)
    generations, at, lookups = [[]], 0, 0
    for _ in range(12):
        ks = rng.integers(0, 400, 60)
        rows = pd.DataFrame({"k": ks, "i": range(at, at + 60), "h0": ks * 7919, "h1": ks * 104729 + (ks << 40), "bucket": 0})
        out = next(p.handleInputRows(0, iter([rows]), None))
        lookups += p.lookups
        known, new = {k for g in generations for k in g}, []
        for k, d in zip(ks.tolist(), out["_is_duplicate"].tolist(), strict=True):
            assert d == (k in known or k in new)
            if not d:
                new.append(k)
        for k in new:
            if len(generations[-1]) >= max(1, capacity // seen.GENERATIONS):
                generations.append([])
            generations[-1].append(k)
        generations = generations[-seen.GENERATIONS :]
        at += 60
        assert len(p.keys.d) == sum(map(len, generations)) <= capacity
        assert sum(len(v[0]) for v in p.filters.d.values()) <= seen.GENERATIONS * (capacity // seen.GENERATIONS * bits / 8 + seen.BLOCK / 8)
    assert lookups >= 300 if bits < 1 else True


@pytest.mark.parametrize("capacity", [100_000, 20_000])
def test_many_new_keys_are_packed(capacity):
    """A row for each of many keys is a round trip for each; pages are exact too, and go with their generation."""
    p = seen.Seen(["k", "i"], "i", capacity, 12.0)
    p.filters, p.keys, p.pages = Keyed(), Keyed(), Keyed()
    p.pages.getValue = p.pages.d.get
    rng = np.random.default_rng(3)
    generations = [[]]
    for n in (3000, 4000, 50, 6000, 9000, 100, 9000, 8000):
        ks = rng.integers(0, 40_000, n)
        rows = pd.DataFrame({"k": ks, "i": range(n), "h0": ks * 7919, "h1": ks * 104729 + (ks << 40), "bucket": 0})
        out = next(p.handleInputRows(0, iter([rows]), None))
        known, new = {k for g in generations for k in g}, []
        for k, d in zip(ks.tolist(), out["_is_duplicate"].tolist(), strict=True):
            assert d == (k in known)
            if not d:
                known.add(k)
                new.append(k)
        for k in new:
            if len(generations[-1]) >= capacity // seen.GENERATIONS:
                generations.append([])
            generations[-1].append(k)
        generations = generations[-seen.GENERATIONS :]
        assert len(p.keys.d) + sum(len(v[0]) // 16 for v in p.pages.d.values()) == sum(map(len, generations)) <= capacity
    assert len(p.keys.d) < 1000


def test_few_new_keys_are_looked_up():
    bloom = seen.Bloom(5000, 12.0)
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, (2, 10_000))
    bloom.add(h[0][:5000], h[1][:5000])
    assert bloom.may_hold(h[0][:5000], h[1][:5000]).all() and bloom.may_hold(h[0][5000:], h[1][5000:]).mean() < 0.02
