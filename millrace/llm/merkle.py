"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a root over all, and every row's proof.

Trees take three nodes to one. Rows of a group are numbered in order by range partitions
and carried counts, so a group of any size is split, and cut into aligned blocks of 729. A
tier of blocks gives block roots, which are the next tier's nodes, until one node of each
group remains; the groups' roots go through the same tiers as one more group. Proofs come
down again: a block gets the path of its own root (the distributed upper part) and walks its
leaves by fractal traversal. It holds, for every two levels, the subtree that covers the
present leaf and the next one to its right, which grows by a few digests a step, and
emits one authentication path after the other. Beside its leaves a block so needs
3 x 2 subtrees of nine leaves and one short stack for each, whatever the table's size.

Defined cases: nulls in any column are digested as ``-``; empty and very long texts are leaves
like others; rows of equal key are ordered by leaf, so repeated rows have equal leaves in
neighbouring places; a null key comes first, null groups come first; an empty table has no
rows and no root; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Nodes under one parent; levels of a block and of a stacked subtree.
FAN, LEVELS, SUB = 3, 6, 2
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A path from a node to its root: at each level what stands left and right of it in its run of three.
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x.left, acc, x.right).cast("binary"), 256))


def proof(path: Column) -> Column:
    """One digest of all siblings, level by level upwards, from left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x.left, x.right))).cast("binary"), 256)


def parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes, until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


class Subtree:
    """The nodes of levels low..high of the subtree over leaves start.. of a block, grown leaf by leaf.

    A node is finished as soon as its last child is, so open nodes are one short run for each level; of
    finished nodes only those from level ``low`` upwards are kept.
    """

    def __init__(self, leaves: list[str], start: int, low: int, high: int) -> None:
        self.leaves, self.low, self.high, self.at = leaves, low, high, start
        self.end = min(start + FAN**high, len(leaves))
        self.open: list[list[str]] = [[] for _ in range(high)]
        self.kept: dict[tuple[int, int], str] = {}

    def grow(self, steps: int) -> None:
        for _ in range(min(steps, self.end - self.at)):
            node, place = self.leaves[self.at], self.at
            last = self.at + 1 == self.end  # ends short runs
            for level in range(self.high + 1):
                if level >= self.low:
                    self.kept[level, place] = node
                if level == self.high:
                    break
                self.open[level].append(node)
                if len(self.open[level]) < FAN and not last:
                    break
                node, place = parent(self.open[level]), place // FAN
                self.open[level] = []
            self.at += 1

    def whole(self) -> Subtree:
        self.grow(self.end - self.at)
        return self


def root_of(leaves: list[str], levels: int) -> str:
    return Subtree(leaves, 0, levels, levels).whole().kept[levels, 0]


def paths(leaves: list[str], levels: int) -> Iterator[list[dict[str, str]]]:
    """Each leaf's path in its block, in order, by fractal traversal."""
    cuts = [(low, min(low + SUB, levels)) for low in range(0, levels, SUB)]
    existing = [Subtree(leaves, 0, low, high).whole() for low, high in cuts]
    desired = [Subtree(leaves, FAN**high, low, high) for low, high in cuts]
    for i in range(len(leaves)):
        path = []
        for (low, high), tree in zip(cuts, existing, strict=True):
            for level in range(low, high):
                place = i // FAN**level
                first = place - place % FAN
                path.append({
                    "left": "".join(tree.kept[level, p] for p in range(first, place)),
                    "right": "".join(tree.kept.get((level, p), "") for p in range(place + 1, first + FAN)),
                })
        yield path
        for k, (low, high) in enumerate(cuts):
            desired[k].grow(1)
            if (i + 1) % FAN**high == 0:
                existing[k], desired[k] = desired[k], Subtree(leaves, i + 1 + FAN**high, low, high)


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """group, pos (from 0, without gaps), size (nodes of the group) and the other columns, stored.

    Ranges of (group, order, row) split a hot group and even equal rows; counts are carried between ranges.
    """
    rows = C.written(nodes.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    ranged = rows.repartitionByRange("group", *order, "row").withColumn("part", F.spark_partition_id())
    ranged = C.written(ranged, f"{name}-ranged")
    counts = ranged.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("group")).alias("size"))
    carried = C.written(carried.withColumnsRenamed({"group": "_group", "part": "_part"}), f"{name}-carried")
    inside = F.row_number().over(Window.partitionBy("part", "group").orderBy(*order, "row"))
    out = ranged.withColumn("inside", inside).join(carried, (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group")))
    return C.written(out.select("group", (F.col("base") + F.col("inside") - 1).alias("pos"), "size", *[c for c in nodes.columns if c != "group"]), f"{name}-placed")


def blocks_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def levels_of(size: int) -> int:
    """Levels of a block: all of them if the group has several, else up to its root."""
    return LEVELS if size > BLOCK else height(size)


def sorted_block(table: pa.Table) -> pa.Table:
    return table.sort_by("pos").combine_chunks()


def roots(nodes: DataFrame) -> DataFrame:
    """group, pos, size, node of the tier above: a node for each block."""
    group = nodes.schema["group"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = sorted_block(table)
        size = table.column("size")[0].as_py()
        root = root_of(table.column("node").to_pylist(), levels_of(size))
        return pa.table({"group": table.column("group").slice(0, 1), "pos": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-size // BLOCK)], pa.int64()), "node": [root]})

    return blocks_of(nodes.select("group", "pos", "size", "node")).groupBy("group", "block").applyInArrow(run, f"group {group}, pos long, size long, node string")


def descended(nodes: DataFrame, upper: DataFrame | None) -> DataFrame:
    """``nodes`` (group, pos, size, node, ...) with ``path``: inside the block, then the block's own (``upper``: group, pos, path)."""
    names = list(nodes.columns)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def walked(table: pa.Table, above: list) -> pa.Table:
        table = sorted_block(table)
        out = [p + above for p in paths(table.column("node").to_pylist(), levels_of(table.column("size")[0].as_py()))]
        return table.select(names).append_column("path", pa.array(out, kind))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields) + f", path {PATH}"
    mine = blocks_of(nodes).groupBy("group", "block")
    if upper is None:
        return mine.applyInArrow(lambda table: walked(table, []), ddl)
    theirs = upper.select("group", F.col("pos").alias("block"), "path").groupBy("group", "block")
    return mine.cogroup(theirs).applyInArrow(lambda table, above: walked(table, above.column("path")[0].as_py() or []), ddl)


def tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and the tiers above, the last of which has one node for each group; each is stored."""
    out = [nodes]
    while out[-1].where("size > 1").limit(1).count():
        out.append(C.written(roots(out[-1]), f"{name}-tier{len(out)}"))
    return out


def with_paths(stack: list[DataFrame], top: DataFrame | None, name: str) -> DataFrame:
    """The lowest tier with the paths to the ends of ``top`` (group, pos 0, path; none: the groups' own roots).

    If a tier has one node a group, the path there is ``top``'s.
    """
    upper = top
    if len(stack) > 1:
        for k in range(len(stack) - 2, 0, -1):
            upper = C.written(descended(stack[k].select("group", "pos", "size", "node"), upper).select("group", "pos", "path"), f"{name}-paths{k}")
    return descended(stack[0], upper)


@dataclass
class Manifest:
    """Stored tiers of each group's tree and of the tree over the groups' roots."""

    groups: list[DataFrame]
    top: list[DataFrame]

    @classmethod
    def of(cls, leaves: DataFrame, order: list[str], name: str = "merkle") -> Manifest:
        """``leaves``: group, node (digest) and the columns of ``order``; others stay with the leaves."""
        groups = tiers(placed(leaves, [*order, "node"], f"{name}-leaves"), f"{name}-group")
        ends = groups[-1].select(F.lit(0).alias("group"), F.col("group").alias("of"), "node")
        return cls(groups, tiers(placed(ends, ["of"], f"{name}-ends"), f"{name}-top"))

    def root(self) -> str | None:
        """One string; None of an empty table."""
        row = self.top[-1].select("node").first()
        return row.node if row else None

    def subroots(self) -> DataFrame:
        """group, subroot."""
        return self.groups[-1].select("group", F.col("node").alias("subroot"))

    def proofs(self) -> DataFrame:
        """The leaves with subroot, root and path (``fold`` leads from a leaf and its path to the root)."""
        ends = with_paths(self.top, None, "merkle-top").select(F.col("of").alias("group"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"))
        ends = C.written(ends, "merkle-ends-paths")
        out = with_paths(self.groups, ends.select("group", "pos", "path"), "merkle-groups")
        subroots = ends.select(F.col("group").alias("_group"), "subroot")
        return out.join(subroots, F.col("group").eqNullSafe(F.col("_group"))).drop("_group").withColumn("root", F.lit(self.root()).cast("string"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line ends where crc32 of the id in decimal is even (a null id has none)."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether a copy whose line ends were removed still leads to the root."""
    docs = C.table(spark, sf_dir, "documents").select(*FIELDS)
    changed = [tampered(F.col("text"), F.col("doc_id")) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("source").alias("group"), "doc_id", leaf(*map(F.col, FIELDS)).alias("node"), leaf(*changed).alias("seen"))
    out = Manifest.of(leaves, ["doc_id"]).proofs()
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE
crc_table AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS n)
),
docs AS (
    SELECT doc_id, source, lang, n_chars, text,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])) % 2 = 1 AS even  -- before the last complement
    FROM documents, crc_table
),
fields AS (
    SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS changed,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head
    FROM docs
),
leaves AS (
    SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN changed IS NULL THEN '-' ELSE strlen(changed) || ':' || changed END) AS seen
    FROM fields
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER () AS id
    FROM leaves
),
nodes AS (
    SELECT 0 AS level, grp, pos, size, leaf AS node FROM numbered
    UNION ALL
    SELECT level + 1, grp, pos // 3, max((size + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY level, grp, pos // 3
),
subroots AS (SELECT grp, node, level AS top FROM nodes WHERE size = 1),
upper AS (
    SELECT 0 AS level, grp AS pos, count(*) OVER () AS size, node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, max((size + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE size > 1 GROUP BY level, pos // 3
),
root AS (SELECT node AS root FROM upper WHERE size = 1),
runs AS (SELECT level, grp, pos // 3 AS run, list(node ORDER BY pos) AS members FROM nodes WHERE size > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 3 AS run, list(node ORDER BY pos) AS members FROM upper WHERE size > 1 GROUP BY ALL),
walk AS (
    SELECT id, grp, 0 AS level, pos, seen AS acc, '' AS siblings FROM numbered
    UNION ALL
    SELECT id, grp, level + 1, pos // 3,
        sha256(array_to_string(members[:pos % 3], '') || acc || array_to_string(members[pos % 3 + 2:], '')),
        siblings || array_to_string(members[:pos % 3], '') || array_to_string(members[pos % 3 + 2:], '')
    FROM walk JOIN runs USING (level, grp) WHERE run = pos // 3
),
climb AS (
    SELECT id, 0 AS level, w.grp AS pos, acc, siblings FROM walk w JOIN subroots s ON w.grp = s.grp AND w.level = s.top
    UNION ALL
    SELECT id, level + 1, pos // 3,
        sha256(array_to_string(members[:pos % 3], '') || acc || array_to_string(members[pos % 3 + 2:], '')),
        siblings || array_to_string(members[:pos % 3], '') || array_to_string(members[pos % 3 + 2:], '')
    FROM climb JOIN upper_runs USING (level) WHERE run = pos // 3
),
ends AS (SELECT id, acc, siblings FROM climb WHERE level = (SELECT max(level) FROM upper))
SELECT doc_id, leaf, s.node AS subroot, root, sha256(siblings) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM numbered JOIN ends USING (id) JOIN subroots s USING (grp), root
"""
