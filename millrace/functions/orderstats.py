"""Order statistics: values at given places of the sorted values, for groups of any size, and as they run.

Groups: distinct values are counted, dealt to partitions by range of (group, value) and stored;
each partition's totals are carried to the later ones, and a window inside each (group,
partition) finds the places. No task sees a whole group unless it is small.

Running: see ``running_statistics``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ordered as D
from millrace.functions import running as R
from millrace.session import drop_written, written

# The names and shares of the percentiles.
PERCENTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def floor_place(n: Column, p: float) -> Column:
    """The place int(n * p), at most the last."""
    return F.least(F.floor(n * F.lit(float(p))), n - 1)


def pick(values: Column, p: float) -> Column:
    """Of an array (nulls aside); null if it is empty. For the windows of streams, which hold their values."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(s, floor_place(F.size(s), p).cast("int"))


def group_places(df: DataFrame, groups: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """groups and, under each name, the value at that place (from 0; a function of _all, the number of values) of each group's sorted values.

    Null is a group; null values do not count; groups without values give no row.
    """
    named = {g: f"_g{i}" for i, g in enumerate(groups)}
    keys = list(named.values())
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(g).alias(k) for g, k in named.items()], F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    stored = written(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "orderstats")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a group has as many rows here as partitions
    totals = stored.groupBy(*keys, "_part").agg(F.sum("_n").alias("_own")) if keys else stored.groupBy("_part").agg(F.sum("_n").alias("_own"))
    carried = totals.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).withColumn("_all", F.sum("_own").over(Window.partitionBy(*keys)))
    carried = carried.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_part").alias("_partc"), "_before", "_all")
    on = F.col("_part") == F.col("_partc")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}c"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v")
    ranked = stored.join(carried, on).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    hit = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
    made = [F.max(F.when(hit(at), F.col("_v"))).alias(k) for k, at in places.items()]
    found = written(ranked.groupBy(*keys).agg(*made), "orderstats-found")
    drop_written(stored)
    return found.select(*[F.col(k).alias(g) for g, k in named.items()], *places)


def group_percentiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float] | None = None) -> DataFrame:
    """Floor-index percentiles of each group."""
    return group_places(df, groups, value, {k: floor_place(F.col("_all"), p) for k, p in (PERCENTILES if wanted is None else wanted).items()})


def group_statistics(df: DataFrame, groups: list[str], value: str, names: list[str]) -> DataFrame:
    """groups and each of ``names``: percentiles, and median (the mean of the two middle values)."""
    places = {k: floor_place(F.col("_all"), PERCENTILES[k]) for k in names if k != "median"}
    if "median" in names:
        places |= {"_low": F.floor((F.col("_all") - 1) / 2), "_high": F.floor(F.col("_all") / 2)}
    out = group_places(df, groups, value, places)
    return out.select(*groups, *[((F.col("_low") + F.col("_high")) / 2).alias(n) if n == "median" else F.col(n) for n in names])


#: Values of a range at most, as a power of two.
RANGE_BITS = 14
#: Rows of the table of wanted ranges up to which it is broadcast.
MOST_SENT = 500_000


def place_of(n: np.ndarray, p: float) -> np.ndarray:
    return np.minimum(np.floor(n * p).astype(np.int64), n - 1)


#: The places (from 0) that a statistic takes among n values; their mean is the statistic.
PLACES = {k: [lambda n, p=p: place_of(n, p)] for k, p in PERCENTILES.items()} | {"median": [lambda n: (n - 1) // 2, lambda n: n // 2], "q1": [lambda n: n // 4], "q3": [lambda n: 3 * n // 4]}


def selected(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The place-th smallest of symbols[left:right], for all queries at once: the levels of a wavelet matrix, one after the other.

    ``symbols`` are 0 .. len - 1, each once. Each level splits the sequence by one bit, and each query goes to the side that holds its place.
    """
    out = np.zeros(len(left), np.int64)
    for bit in range(max(len(symbols) - 1, 0).bit_length() - 1, -1, -1):
        high = (symbols >> bit) & 1
        low = np.r_[0, np.cumsum(1 - high)]
        a, b = low[left], low[right]
        up = place >= b - a
        left, right = np.where(up, low[-1] + left - a, a), np.where(up, low[-1] + right - b, b)
        place = np.where(up, place - (b - a), place)
        out |= up.astype(np.int64) << bit
        symbols = np.concatenate([symbols[high == 0], symbols[high == 1]])
    return out


def bounds(kinds: list[str], core: int, more: int) -> list[tuple[int, int]]:
    """For each place of ``kinds``: which places among ``core`` sorted values can be asked for when up to ``more`` others join them.

    A place grows by one at most with each further value, so the lowest comes when all have joined and stand below.
    """
    out = []
    for k in kinds:
        for f in PLACES[k]:
            top = int(f(np.array([core + more]))[0])
            out.append((max(0, top - more - 2), min(core - 1, top + 2)))
    return out


def wanted(kinds: list[str], table: pa.Table) -> pa.Table:
    """Of a block's rows (range, base, before: values below the range and of it among the core), those that a place may fall into."""
    base, before = (table.column(c).to_numpy() for c in ("base", "before"))
    take = np.zeros(len(base), bool)
    for lo, hi in bounds(kinds, table.column("core")[0].as_py(), table.column("more")[0].as_py()):
        take |= (before > 0) & (base <= hi) & (base + before > lo)
    return table.filter(pa.array(take))


def solved(kinds: list[str], rows: pa.Table, prior: pa.Table | None, back: int | None, x: str, t: str, pos: str, marks: list[str]) -> tuple[pa.Table, dict[str, np.ndarray], np.ndarray]:
    """A block's rows in order, each statistic of each of them (NaN and its mask: none), and which row ends the block's first run of one time.

    The sequence is: earlier rows that some frames of the block hold and others don't (halo), the wanted values that all hold (core),
    the block's own. A frame is a stretch of it, and ``selected`` answers all frames of all groups at once.
    """
    rows = rows.sort_by(pos).combine_chunks()
    n, own = rows.num_rows, rows.column(x).combine_chunks()
    valid = ~np.asarray(own.is_null())
    value = own.fill_null(0.0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(valid)
    changes = np.zeros(n, bool)
    for m in marks:
        v = rows.column(m).to_numpy()
        changes[1:] |= v[1:] != v[:-1]
    seg = np.cumsum(changes)
    first = np.searchsorted(seg, seg)  # of each row's group in this block
    end = np.arange(n)
    begin = first
    if back is not None:
        time = rows.column(t).combine_chunks().fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.r_[(np.diff(time) != 0) | (np.diff(seg) != 0), True])
        end = ends[np.searchsorted(ends, end)]
        # rows of the group before the frame: their place in one sort with the frames' starts
        both = np.lexsort((np.r_[np.ones(n), np.zeros(n)], np.r_[time, time - back], np.r_[seg, seg]))
        begin = np.empty(n, np.int64)
        asked = both >= n
        begin[both[asked] - n] = np.cumsum(~asked)[asked]
    before = np.r_[0, upto]
    halo, core, times = np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
    unseen = [0] * sum(len(PLACES[k]) for k in kinds)
    all_core = 0
    if prior is not None and prior.num_rows:
        kind = prior.column("kind").to_numpy()
        pv, one, two = prior.column("x").to_numpy(zero_copy_only=False), prior.column("a").to_numpy(zero_copy_only=False), prior.column("b").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kind == 0)
        at = at[np.argsort(two[at])]
        halo, times = pv[at], one[at]
        core = pv[kind == 1]
        info = np.flatnonzero(kind == 2)
        if len(info):
            base, held = (c[info].astype(np.int64) for c in (one, two))
            all_core, more = (int(c[kind == 3][0]) for c in (one, two))
            order = np.argsort(base)
            base, held = base[order], held[order]
            fetched = np.cumsum(held) - held
            for i, (lo, _) in enumerate(bounds(kinds, all_core, more)):
                k = min(np.searchsorted(base + held, lo, "right"), len(base) - 1)
                unseen[i] = int(base[k] - fetched[k])
    p = len(halo) + len(core)
    left, right = p + before[begin], p + before[end + 1]
    early = seg == 0
    if p or all_core:
        start = np.zeros(n, np.int64) if back is None else np.searchsorted(times, time - back)
        inside = early & ((start < len(halo)) | (all_core > 0))
        left = np.where(inside, np.minimum(start, len(halo)), left)
    rest = np.where(early, all_core - len(core), 0)  # of the core, not fetched
    count = right - left + rest
    sequence = np.r_[halo, core, value[valid]]
    ranked = np.argsort(sequence, kind="stable")
    symbols = np.empty(len(sequence), np.int64)
    symbols[ranked] = np.arange(len(sequence))
    sequence = sequence[ranked]
    out, i = {}, 0
    some = np.flatnonzero(count > 0)
    for k in kinds:
        found = np.zeros(len(some))
        for f in PLACES[k]:
            place = f(count[some]) - np.where(early[some], unseen[i], 0)
            found = found + sequence[selected(symbols, left[some], right[some], place)]
            i += 1
        out[k] = np.full(n, np.nan)
        out[k][some] = found / len(PLACES[k])
    edge = np.zeros(n, bool)
    if n and back is not None:
        edge[end[0]] = True
    return rows, out | {"": count > 0}, edge


def running_statistics(df: DataFrame, groups: list[Column], order: list[Column], value: Column, made: dict[str, str], back: int | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with columns of running statistics (column name -> "median", "p25", ..., "unique") of each row's frame.

    Frames: all rows of the group up to this one in ``order``; with ``back``, rows whose first order value lies at most ``back``
    below (and all rows of the same one, also later ones). Null values don't count; frames without values give null (unique: 0).

    Rows are stored in blocks of (group, order). A group that spans blocks is also cut into ranges of its values, with the count of
    each (block, range) carried as prefix sums. They tell in which ranges the places that a block asks for can lie: as its own m rows move a place by
    m at most, about 2m earlier values for each place, which the block gets, wherever its group began. A block so needs
    memory for its own rows, those that leave its frames, and these, and no task holds a group.
    """
    unique = {m: k for m, k in made.items() if k == "unique"}
    if unique:
        df = running_unique(df, groups, order, value, list(unique), back, parts)
        made = {m: k for m, k in made.items() if k != "unique"}
    if not made:
        return df
    names, kinds = df.columns, list(dict.fromkeys(made.values()))
    x, t, pos, block, g0, g1, edge = (D.fresh(df, c) for c in ("_x", "_t", "_pos", "_block", "_g0", "_g1", "_edge"))
    keys, sorts = [D.fresh(df, f"_k{i}") for i in range(len(groups))], [D.fresh(df, f"_o{i}") for i in range(len(order))]
    time = (order[0].cast("long") if back is not None else F.lit(None).cast("long")).alias(t)
    frame = df.select(*names, *[g.alias(k) for g, k in zip(groups, keys, strict=True)], *[o.alias(k) for o, k in zip(order, sorts, strict=True)], value.cast("double").alias(x), time, *D.marks(groups, g0, g1))
    stored = D.placed(frame, [*keys, *sorts], pos, "running-rows", parts).drop(*keys, *sorts).withColumn(block, D.block_of(pos))
    prior = _prior(stored.select(g0, g1, F.col(block).alias("block"), F.col(pos).alias("pos"), F.col(t).alias("t"), F.col(x).alias("x")).withColumnsRenamed({g0: "g0", g1: "g1"}), kinds, back)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{m}` double" for m in made)
    if back is not None:
        types += f", `{g0}` long, `{g1}` long, `{t}` long, `{block}` long, `{edge}` boolean"

    def run(rows: pa.Table, earlier: pa.Table | None = None) -> pa.Table:
        rows, found, first_end = solved(kinds, rows, earlier, back, x, t, pos, [g0, g1])
        out = rows.select(names)
        for m, k in made.items():
            out = out.append_column(m, pa.array(found[k], pa.float64(), mask=~found[""]))
        if back is not None:
            for c in (g0, g1, t, block):
                out = out.append_column(c, rows.column(c))
            out = out.append_column(edge, pa.array(first_end))
        return out

    if prior is None:
        out = stored.groupBy(block).applyInArrow(lambda rows: run(rows), types)
    else:
        out = stored.groupBy(block).cogroup(prior.groupBy("target")).applyInArrow(run, types)
    if back is None:
        return out
    if prior is None:
        return out.drop(g0, g1, t, block, edge)
    # rows of one time share the frame of the last of them, which may stand in a later block: one row for each block
    out = written(out, "running-solved")
    last = out.where(edge).groupBy(g0, g1, t).agg(F.max_by(F.struct(*made), block).alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = last.select(F.col(g0).alias("_l0"), F.col(g1).alias("_l1"), F.col(t).alias("_lt"), "_last")
    out = out.join(F.broadcast(last), (F.col(g0) == F.col("_l0")) & (F.col(g1) == F.col("_l1")) & F.col(t).eqNullSafe(F.col("_lt")), "left")
    return out.select(*names, *[F.when(F.col("_l0").isNotNull(), F.col(f"_last.{m}")).otherwise(F.col(m)).alias(m) for m in made])


def _prior(rows: DataFrame, kinds: list[str], back: int | None) -> DataFrame | None:
    """What blocks need of earlier ones: target (block), kind, x, a and b: 0 a row of the halo (a its time, b its pos), 1 a core value, 2 a wanted range (a base, b before), 3 the counts core and more.

    Ranges are stretches of at most ``2 ** RANGE_BITS`` values, less than a block has, as a block gets them whole. Only groups that span blocks have any, at most one in each block, so the tables over (group, block) and (group, range) hold
    at most two rows for each partition.
    """
    g = ["g0", "g1"]
    segments = rows.groupBy(*g, "block").agg(F.count("x").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    spans = segments.withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy(*g)))
    spans = written(spans.where("blocks > 1").drop("blocks"), "running-spans")
    if not spans.limit(1).count():
        return None
    every = rows.where(F.col("x").isNotNull()).join(F.broadcast(spans.select(*g).distinct()), g)
    # ranges of each group's values, and the values of each (range, block)
    ranged = every.repartitionByRange(*g, "x", "pos").sortWithinPartitions(*g, "x", "pos").withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))
    ranged = written(ranged, "running-ranges")
    cells = ranged.groupBy(*g, "range", "block").agg(F.count(F.lit(1)).alias("own"))
    grid = cells.select(*g, "range").distinct().join(F.broadcast(spans.select(*g, "block")), g).join(cells, [*g, "range", "block"], "left")
    prefix = F.sum(F.coalesce("own", F.lit(0))).over(Window.partitionBy(*g, "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    grid = written(grid.select(*g, "range", "block", F.coalesce(prefix, F.lit(0)).alias("upto")), "running-grid")
    # each block's core: the blocks from ``since`` to itself, whole in all its frames; and the blocks that are in part
    parted = None
    if back is None:
        before = D.earlier(g, "block")
        cores = spans.select(*g, F.col("block").alias("target"), F.min("block").over(before).alias("since"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("core"), F.col("n").alias("more"))
    else:
        here = spans.select(*g, F.col("block").alias("target"), F.col("low").alias("t0"), F.col("high").alias("t1"), F.col("n").alias("m"))
        pairs = spans.join(F.broadcast(here), g).where((F.col("block") < F.col("target")) & (F.col("high") >= F.col("t0") - back))
        pairs = pairs.withColumn("whole", F.coalesce(F.col("low") >= F.col("t1") - back, F.lit(False)))
        n = lambda whole: F.coalesce(F.sum(F.when(F.col("whole") == whole, F.col("n"))), F.lit(0))
        cores = pairs.groupBy(*g, "target").agg(F.min(F.when(F.col("whole"), F.col("block"))).alias("since"), n(True).alias("core"), (F.first("m") + n(False)).alias("more"))
        parted = written(pairs.where("NOT whole").select(*g, "target", "block"), "running-parted")
    cores = cores.where("core > 0")
    since = grid.select(*g, "range", F.col("block").alias("since"), F.col("upto").alias("less"))
    counted = grid.withColumnRenamed("block", "target").join(F.broadcast(cores), [*g, "target"]).join(since, [*g, "range", "since"])
    counted = counted.withColumn("before", F.col("upto") - F.col("less"))
    base = F.coalesce(F.sum("before").over(Window.partitionBy(*g, "target").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needs = counted.select(*g, "target", "range", "since", base.alias("base"), "before", "core", "more")
    needs = needs.groupBy("target").applyInArrow(lambda table: wanted(kinds, table), needs.schema)
    needs = written(needs, "running-needs")
    asked = needs.select(*g, "target", "range", "since")
    if asked.count() <= MOST_SENT:
        asked = F.broadcast(asked)
    sent = lambda kind, x, a, b: ("target", F.lit(kind).alias("kind"), x.cast("double").alias("x"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    none = F.lit(None)
    core = ranged.join(asked, [*g, "range"]).where("block < target AND block >= since")
    out = core.select(*sent(1, F.col("x"), none, none)).unionByName(needs.select(*sent(2, none, F.col("base"), F.col("before"))))
    out = out.unionByName(needs.groupBy("target").agg(F.max("core").alias("core"), F.max("more").alias("more")).select(*sent(3, none, F.col("core"), F.col("more"))))
    if parted is not None:
        halo = every.join(F.broadcast(parted), [*g, "block"])
        out = out.unionByName(halo.select(*sent(0, F.col("x"), F.col("t"), F.col("pos"))))
    return out


def running_unique(df: DataFrame, groups: list[Column], order: list[Column], value: Column, names: list[str], back: int | None, parts: int | None = None) -> DataFrame:
    """``df`` with the number of different values in each row's frame, as ``running_statistics`` has them.

    A value is in the frames from its first time to ``back`` after its last, but for gaps longer than that: so a row's count
    is the starts up to it less the ends before it, a running sum over blocks. No value's rows meet in one task.
    """
    row, g0, g1, t, n = (D.fresh(df, c) for c in ("_row", "_g0", "_g1", "_t", "_n"))
    sorts = [D.fresh(df, f"_o{i}") for i in range(len(order))]
    keys = [D.fresh(df, f"_k{i}") for i in range(len(groups))]
    frame = df.select(*df.columns, *[c.alias(k) for c, k in zip([*groups, *order], [*keys, *sorts], strict=True)], value.cast("double").alias(n), *D.marks(groups, g0, g1))
    stored = D.placed(frame, [*keys, *sorts], row, "unique-rows", parts)
    at = F.col(row) if back is None else F.col(sorts[0]).cast("long")
    stored = stored.withColumn(t, at)
    seen = stored.where(F.col(n).isNotNull()).select(F.col(g0).alias("g0"), F.col(g1).alias("g1"), F.col(n).alias("v"), F.col(t).alias("t")).distinct()
    line = R.Blocks.of(seen, [F.col("g0"), F.col("g1"), F.col("v")], [F.col("t")], parts).running({"prev": ("last", F.col("t"))}, inclusive=False).rows("prev")
    starts = line.where(F.col("prev").isNull() if back is None else F.col("prev").isNull() | (F.col("t") - F.col("prev") > back))
    events = starts.select("g0", "g1", "t", F.lit(0).alias("kind"), F.lit(1).alias("d"))
    if back is not None:
        ends = starts.where(F.col("prev").isNotNull()).select("g0", "g1", (F.col("prev") + back).alias("t"), F.lit(2).alias("kind"), F.lit(-1).alias("d"))
        last = seen.groupBy("g0", "g1", "v").agg((F.max("t") + back).alias("t")).select("g0", "g1", "t", F.lit(2).alias("kind"), F.lit(-1).alias("d"))
        events = events.unionByName(ends).unionByName(last)
    asked = stored.groupBy(F.col(g0).alias("g0"), F.col(g1).alias("g1"), F.col(t).alias("t")).agg(F.count(F.lit(1)).alias("copies"))
    events = events.groupBy("g0", "g1", "t", "kind").agg(F.sum("d").alias("d"), F.lit(None).cast("long").alias("copies"))
    events = events.unionByName(asked.select("g0", "g1", "t", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("d"), "copies"))
    sums = R.Blocks.of(events, [F.col("g0"), F.col("g1")], [F.col("t"), F.col("kind")], parts).running({"s": ("sum", F.col("d"))}).rows("s")
    counts = written(sums.where("kind = 1").select(F.col("g0").alias(g0), F.col("g1").alias(g1), F.coalesce("t", F.lit(-(1 << 62))).alias("_at"), F.col("s").cast("long").alias("_count"), F.col("copies").alias("_copies")), "unique-counts")
    out = D.spread(stored.withColumn("_at", F.coalesce(t, F.lit(-(1 << 62)))), counts, [g0, g1, "_at"], "_copies")
    return out.select(*df.columns, *[F.col("_count").alias(m) for m in names])
