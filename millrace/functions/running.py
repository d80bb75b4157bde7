"""Running values in the order of a column, over all rows or for each group, without one task for all rows.

Without groups, rows are dealt to blocks between quantiles of the order column, so that outliers and crowded
ranges make no large block; a block's totals are carried to the later ones (a table of as many rows as
blocks) and the rest is a window inside each block. ``Blocks`` does the same for groups of any size, in any order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ordered as D
from millrace.session import written

#: Rows that a block is meant to hold, and blocks at most.
BLOCK_ROWS, BLOCKS = 5000, 4096

#: How a running value is made of a block's own and of what is carried into it.
_JOIN = {
    "sum": lambda carried, own: F.coalesce(carried, F.lit(0.0)) + F.coalesce(own, F.lit(0.0)),
    "count": lambda carried, own: F.coalesce(carried, F.lit(0)) + own,
    "min": lambda carried, own: F.least(carried, own),
    "max": lambda carried, own: F.greatest(carried, own),
    "last": lambda carried, own: F.coalesce(own, carried),
    "first": lambda carried, own: F.coalesce(carried, own),
}


def _over(kind: str, c: Column) -> Column:
    return {"sum": F.sum(c), "count": F.count(c), "min": F.min(c), "max": F.max(c), "last": F.last(c, ignorenulls=True), "first": F.first(c, ignorenulls=True)}[kind]


def cuts(df: DataFrame, order: str, blocks: int = BLOCKS) -> list:
    """Values that cut the order column into blocks of about equal numbers of rows: quantiles, by one aggregation."""
    row = df.agg(F.count(order).alias("n"), F.percentile_approx(order, [k / blocks for k in range(1, blocks)], 10 * blocks).alias("q")).first()
    if not row.n:
        return []
    step = max(1, blocks // max(1, min(blocks, row.n // BLOCK_ROWS)))
    return sorted(set(row.q[step - 1 :: step]))


def block_of(c: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below or at the value: a search by halves in the row; nulls come first."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    line = F.lit(bounds)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & F.coalesce(F.get(line, at + step - 1) <= c, F.lit(False)), at + step).otherwise(at))


def running(df: DataFrame, order: str, measures: dict[str, tuple[str, Column]], inclusive: bool = True, backwards: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """``df`` with each measure (kind, column) over all rows up to each row in the order of ``order`` (a unique number)."""
    sign = -1 if backwards else 1
    bounds = cuts(df, order, blocks)
    placed = df.withColumn("_block", block_of(F.col(order), bounds))
    key = F.col(order).desc() if backwards else F.col(order).asc()
    total = []
    for name, (kind, c) in measures.items():
        if kind in ("last", "first"):
            at = F.when(c.isNotNull(), F.col(order) * sign)
            total.append((F.max_by(c, at) if kind == "last" else F.min_by(c, at)).alias(f"_own_{name}"))
        else:
            total.append(_over(kind, c).alias(f"_own_{name}"))
    before = Window.orderBy(F.col("_block") * sign).rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as blocks
    fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    carried = placed.groupBy("_block").agg(*total).select(
        "_block", *[(fold[kind](f"_own_{n}") if kind in fold else _over(kind, F.col(f"_own_{n}"))).over(before).alias(f"_in_{n}") for n, (kind, _) in measures.items()]
    )
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = placed.join(F.broadcast(carried), "_block")
    cols = [_JOIN[kind](F.col(f"_in_{n}"), _over(kind, c).over(inside)).alias(n) for n, (kind, c) in measures.items()]
    return out.select(*[F.col(c) for c in df.columns if c not in measures], *cols)


@dataclass(frozen=True)
class Blocks:
    """Rows stored by range of (group, order), whose running values cross blocks by what is carried into each."""

    df: DataFrame
    names: list[str]
    group: tuple[str, str]
    pos: str

    @classmethod
    def of(cls, df: DataFrame, groups: list[Column], order: list[Column], parts: int | None = None) -> Blocks:
        g0, g1, pos = (D.fresh(df, c) for c in ("_g0", "_g1", "_pos"))
        keys, sorts = [D.fresh(df, f"_k{i}") for i in range(len(groups))], [D.fresh(df, f"_o{i}") for i in range(len(order))]
        frame = df.select(*df.columns, *[c.alias(k) for c, k in zip([*groups, *order], [*keys, *sorts], strict=True)], *D.marks(groups, g0, g1))
        return cls(D.placed(frame, [*keys, *sorts], pos, "running-blocks", parts).drop(*keys, *sorts), df.columns, (g0, g1), pos)

    def running(self, measures: dict[str, tuple[str, Column]], inclusive: bool = True) -> Blocks:
        """Each measure (kind, column) over the rows of the group up to each row (or before it)."""
        g, block = list(self.group), D.fresh(self.df, "_block")
        inputs = {f"_m{i}": c for i, (_, c) in enumerate(measures.values())}
        rows = self.df.select("*", *[c.alias(k) for k, c in inputs.items()], D.block_of(self.pos).alias(block))
        total = []
        for k, (kind, _) in zip(inputs, measures.values(), strict=True):
            at = F.when(F.col(k).isNotNull(), F.col(self.pos))
            total.append((F.max_by(k, at) if kind == "last" else F.min_by(k, at) if kind == "first" else _over(kind, F.col(k))).alias(f"_t{k}"))
        fold = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        before = D.earlier(g, block)
        carried = rows.groupBy(*g, block).agg(*total).withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*g))).where("_blocks > 1")
        carried = carried.select(
            *[F.col(c).alias(f"_c{i}") for i, c in enumerate([*g, block])],
            *[(fold[kind](f"_t{k}") if kind in fold else _over(kind, F.col(f"_t{k}"))).over(before).alias(f"_in{k}") for k, (kind, _) in zip(inputs, measures.values(), strict=True)],
        )  # groups that span blocks: at most two rows for each block
        out = rows.join(F.broadcast(carried), (F.col(g[0]) == F.col("_c0")) & (F.col(g[1]) == F.col("_c1")) & (F.col(block) == F.col("_c2")), "left")
        inside = Window.partitionBy(*g, block).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        made = {n: _JOIN[kind](F.col(f"_in{k}"), _over(kind, F.col(k)).over(inside)) for n, k, (kind, _) in zip(measures, inputs, measures.values(), strict=True)}
        return Blocks(out.select(*[F.col(c) for c in self.df.columns if c not in made], *[v.alias(n) for n, v in made.items()]), self.names, self.group, self.pos)

    def rows(self, *more: str) -> DataFrame:
        return self.df.select(*[c for c in self.names if c not in more], *more)


def trailing(df: DataFrame, groups: list[Column], at: Column, back: int, made: Callable, parts: int | None = None) -> DataFrame:
    """``df`` with made(frame), columns over the rows of the group whose ``at`` (a whole number) lies at most ``back`` below a row's, and on all of its own.

    Blocks of (group, at) get the rows of earlier blocks that their first frame reaches, so neither a group nor the
    table meets in one task. Rows of one value that span blocks take what the last of these blocks has found.
    """
    time, own, target, block = (D.fresh(df, c) for c in ("_at", "_own", "_target", "_block"))
    blocks = Blocks.of(df.withColumn(time, at), groups, [at], parts)
    g = list(blocks.group)
    rows = blocks.df.withColumn(block, D.block_of(blocks.pos))
    spans = rows.groupBy(*g, block).agg(F.min(time).alias("low"), F.max(time).alias("high")).withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy(*g)))
    spans = written(spans.where("blocks > 1").drop("blocks"), "trailing-spans")  # at most two rows for each block
    ahead = spans.select(F.col(g[0]).alias("h0"), F.col(g[1]).alias("h1"), F.col(block).alias(target), (F.col("low") - back).alias("from"))
    reach = spans.join(F.broadcast(ahead), (F.col(g[0]) == F.col("h0")) & (F.col(g[1]) == F.col("h1")) & (F.col(block) < F.col(target)) & (F.col("high") >= F.col("from")))
    reach = F.broadcast(reach.select("h0", "h1", F.col(block).alias("hb"), target, "from"))
    halo = rows.join(reach, (F.col(g[0]) == F.col("h0")) & (F.col(g[1]) == F.col("h1")) & (F.col(block) == F.col("hb")) & (F.col(time) >= F.col("from"))).drop("h0", "h1", "hb", "from")
    every = rows.withColumns({target: F.col(block), own: F.lit(True)}).unionByName(halo.withColumn(own, F.lit(False)))
    columns = made(Window.partitionBy(*g, target).orderBy(time).rangeBetween(-back, 0))
    out = every.withColumns(columns).where(own)
    edges = out.join(F.broadcast(spans.select(F.col(g[0]).alias("h0"), F.col(g[1]).alias("h1"), F.col(block).alias("hb"), F.col("low").alias("from"))), (F.col(g[0]) == F.col("h0")) & (F.col(g[1]) == F.col("h1")) & (F.col(block) == F.col("hb")) & (F.col(time) == F.col("from")))
    edges = edges.groupBy("h0", "h1", "from").agg(F.max_by(F.struct(*columns), "hb").alias("_last"))
    out = out.join(F.broadcast(edges), (F.col(g[0]) == F.col("h0")) & (F.col(g[1]) == F.col("h1")) & (F.col(time) == F.col("from")), "left")
    return out.select(*[c for c in df.columns if c not in columns], *[F.when(F.col("h0").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


#: Of the totals of stretches: how values join, and what stands for none. NaN is Spark's largest number.
_FOLDS = {"count": (np.add, 0), "sum": (np.add, 0.0), "min": (np.fmin, np.nan), "max": (np.maximum, -np.inf)}


def folded(op: np.ufunc, none: float, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """op over values[left:right] (none empty) for all stretches at once, without taking back what is outside of them.

    A stretch is cut in the middle of the smallest aligned range of 2, 4, 8, ... values that holds it: a running op to the middle, one from it.
    """
    last, out = right - 1, values[left]
    level = np.frexp((left ^ last).astype(float))[1]  # 0: one value
    for h in range(1, int(level.max(initial=0)) + 1):
        asked = np.flatnonzero(level == h)
        if len(asked):
            line = np.full(-(-len(values) >> h) << h, none, values.dtype)
            line[: len(values)] = values
            line = line.reshape(-1, 2, 1 << (h - 1))
            line = np.stack([op.accumulate(line[:, 0, ::-1], axis=1)[:, ::-1], op.accumulate(line[:, 1], axis=1)], axis=1).ravel()
            out[asked] = op(line[left[asked]], line[last[asked]])
    return out


def _framed(kinds: dict[str, str], rows: pa.Table, prior: pa.Table | None, back: int, time: str, pos: str, marks: list[str]) -> tuple[pa.Table, dict[str, pa.Array]]:
    """A block's rows in order, and each total (input column -> kind) over each row's frame.

    The sequence is: earlier rows that some frames hold (prior's kind 0), one row of totals for those that all hold (1), the block's own, one row
    for what later blocks have at the last one's time (2). A frame is a stretch of it.
    """
    rows = rows.sort_by(pos).combine_chunks()
    n = rows.num_rows
    at = rows.column(time).fill_null(-(1 << 62)).to_numpy()
    seg = np.zeros(n, np.int64)
    for m in marks:
        v = rows.column(m).to_numpy()
        seg[1:] |= v[1:] != v[:-1]
    seg = np.cumsum(seg)
    ends = np.flatnonzero(np.r_[(np.diff(at) != 0) | (np.diff(seg) != 0), True])
    right = ends[np.searchsorted(ends, np.arange(n))] + 1
    both = np.lexsort((np.r_[np.ones(n), np.zeros(n)], np.r_[at, at - back], np.r_[seg, seg]))
    left, asked = np.empty(n, np.int64), both >= n
    left[both[asked] - n] = np.cumsum(~asked)[asked]
    p = whole = 0
    if prior is not None and prior.num_rows:
        prior = prior.sort_by([("kind", "ascending"), (pos, "ascending")]).combine_chunks()
        kind = prior.column("kind").to_numpy()
        halo, whole, later = (int((kind == k).sum()) for k in range(3))
        p = halo + whole
        start = np.searchsorted(prior.column(time).slice(0, halo).to_numpy(), at - back)
        left, right = left + p, right + p
        left = np.where((seg == 0) & ((start < halo) | (whole > 0)), start, left)
        right[right == p + n] += later
    out = {}
    for c, k in kinds.items():
        line = rows.column(c)
        if p or prior is not None:
            past = prior.column(c).cast(line.type)
            line = pa.chunked_array([*past.slice(0, p).chunks, *line.chunks, *past.slice(p).chunks], line.type)
        op, none = _FOLDS[k]
        known = ~line.is_null().to_numpy()
        values = line.to_numpy().astype(np.int64 if k == "count" else float, copy=True)
        values[~known] = none
        found = folded(op, none, values, left, right)
        some = None if k == "count" else ~folded(np.logical_or, False, known, left, right)
        out[c] = pa.array(found, mask=some)
    return rows, out


def trailing_totals(df: DataFrame, groups: list[Column], at: Column, back: int, measures: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """``df`` with each measure (count, sum, min or max, and its column) over the frames that ``trailing`` has.

    A block gets the rows of earlier blocks that some of its frames hold and others don't: about as many as it has itself. Blocks that all its
    frames hold come as one row of totals, so that neither the length of frames nor that of a group counts. Each frame is
    folded in two steps from running values of aligned ranges.
    """
    time, block = (D.fresh(df, c) for c in ("_at", "_block"))
    inputs = {D.fresh(df, f"_m{i}"): (k, F.when(c.isNotNull(), 1).otherwise(0).cast("long") if k == "count" else c.cast("double")) for i, (k, c) in enumerate(measures.values())}
    blocks = Blocks.of(df.withColumns({time: at.cast("long"), **{c: x for c, (_, x) in inputs.items()}}), groups, [at], parts)
    g, pos = list(blocks.group), blocks.pos
    rows = blocks.df.withColumn(block, D.block_of(pos))
    kinds = {c: k for c, (k, _) in inputs.items()}
    totals = [(F.min(c) if k == "min" else F.max(c) if k == "max" else F.sum(c)).alias(c) for c, k in kinds.items()]
    own = rows.select(F.col(g[0]).alias("g0"), F.col(g[1]).alias("g1"), F.col(block).alias("block"), F.col(time).alias("t"), F.col(pos).alias("pos"), *[F.col(c).alias(c) for c in kinds])
    group = ["g0", "g1"]
    spans = own.groupBy(*group, "block").agg(F.min("t").alias("low"), F.max("t").alias("high"), *totals).withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    spans = written(spans.where("blocks > 1").drop("blocks"), "trailing-spans")  # at most two rows for each block
    here = spans.select(*group, F.col("block").alias("target"), (F.col("low") - back).alias("from"), (F.col("high") - back).alias("upto"))
    pairs = spans.join(F.broadcast(here), group).where((F.col("block") < F.col("target")) & (F.col("high") >= F.col("from")))
    whole = F.coalesce(F.col("low") >= F.col("upto"), F.lit(False))
    made = lambda kind: (F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("pos"), *kinds)
    cores = pairs.where(whole).groupBy("target").agg(*totals).select("target", *made(1))
    halo = own.join(F.broadcast(pairs.where(~whole).select(*group, "block", "target", "from")), [*group, "block"]).where(F.col("t") >= F.col("from")).select("target", F.lit(0).alias("kind"), "t", "pos", *kinds)
    # times that go on in the next block
    goes_on = F.lead("low").over(Window.partitionBy(*group).orderBy("block")) == F.col("high")
    cut = spans.select(*group, F.col("block").alias("target"), F.when(goes_on, F.col("high")).alias("t")).where("t IS NOT NULL")
    ties = own.join(F.broadcast(cut.select(*group, "t").distinct()), [*group, "t"]).groupBy(*group, "t", "block").agg(*totals)
    later = ties.join(F.broadcast(cut), [*group, "t"]).where("block > target").groupBy("target").agg(*totals).select("target", *made(2))
    prior = halo.unionByName(cores).unionByName(later).withColumnsRenamed({"t": time, "pos": pos})
    names, outs = [c for c in df.columns if c not in measures], list(measures)
    types = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names], *[f"`{m}` {'long' if k == 'count' else 'double'}" for m, (k, _) in measures.items()]])

    def run(rows: pa.Table, prior: pa.Table) -> pa.Table:
        rows, found = _framed(kinds, rows, prior, back, time, pos, g)
        out = rows.select(names)
        for m, c in zip(outs, kinds, strict=True):
            out = out.append_column(m, found[c])
        return out

    return rows.groupBy(block).cogroup(prior.groupBy("target")).applyInArrow(run, types)


def last_rows(df: DataFrame, groups: list[Column], order: list[Column], n: int, made: Callable, rows: int = 10_000, parts: int | None = None) -> DataFrame:
    """``df`` with made(frame), columns over a row and the n - 1 rows before it in its group: blocks of numbered rows, each with the n - 1 before it."""
    size = max(rows, n)
    at, own, target = (D.fresh(df, c) for c in ("_at", "_own", "_target"))
    blocks = Blocks.of(df, groups, order, parts).running({at: ("count", F.lit(1))})
    place = F.col(at) - 1
    sent = F.array(F.struct(F.floor(place / size).alias("t"), F.lit(True).alias("o")))
    sent = F.when(place % size > size - n, F.concat(sent, F.array(F.struct((F.floor(place / size) + 1).alias("t"), F.lit(False).alias("o"))))).otherwise(sent)
    dealt = blocks.df.withColumn(target, F.explode(sent)).withColumns({own: F.col(target)["o"]}).withColumn(target, F.col(target)["t"])
    columns = made(Window.partitionBy(*blocks.group, target).orderBy(at).rowsBetween(-(n - 1), 0))
    return dealt.withColumns(columns).where(own).select(*[c for c in df.columns if c not in columns], *columns)
