"""A Merkle manifest of a dataset, with a proof for every row, by fractal traversal.

Every row is a leaf: the SHA-256 of its fields. Leaves are ordered within a group (a language) and get their places from
a range-partitioned table, so that no window spans a group. Places cut a group into aligned blocks of 2**HEIGHT leaves.
One task reads a block's digests and walks over its leaves from left to right: per level of subtrees of STEP levels it
holds the existing subtree, whose nodes are on the current authentication path, and the desired one beside it, which it
builds two steps a leaf, so that it is whole when the walk gets there. A walk holds the digests of its block and
2 * HEIGHT / STEP subtrees, whatever the size of the group.

The roots of blocks are the leaves of the next tier, and so on until one node a group is left; these are the leaves of
the dataset's tree. A row's proof is the path within its block, followed by the paths of its block and of its group,
which a join appends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import broadcast_if_small, groups
from quernel.plans.storage import discard, materialize

HEIGHT = 12  # levels of a block: 4,096 leaves
STEP = 3  # levels of a subtree
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: One level of a path: the other node of the run (null if there is none), and whether it stands to the left.
LEVEL = "struct<digest:string,left:boolean>"


# --- leaves ---------------------------------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its bytes in UTF-8, counted, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


# --- one block ------------------------------------------------------------------------------------------------------


def parent(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node over two nodes in hex digits, or over one; nothing over nothing."""
    if left is None:
        return None
    return hashlib.sha256(left if right is None else left + right).hexdigest().encode()


class Treehash:
    """The nodes of levels ``low`` to ``high`` - 1 under node (``high``, ``index``), computed from leaves step by step.

    A step takes in a leaf or merges two nodes. At most one node a level waits.
    """

    def __init__(self, leaves: list[bytes], low: int, high: int, index: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.next, self.stop = index << high, index + 1 << high
        self.waiting: list[tuple[int, int, bytes | None]] = []  # level, index and digest of nodes without a parent yet
        self.nodes: dict[tuple[int, int], bytes | None] = {}

    def step(self, times: int) -> None:
        for _ in range(times):
            waiting = self.waiting
            if len(waiting) > 1 and waiting[-1][0] == waiting[-2][0]:
                (level, index, left), (_, _, right) = waiting[-2:]
                node = (level + 1, index >> 1, parent(left, right))
                del waiting[-2:]
            elif self.next < self.stop:
                node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
                self.next += 1
            else:
                return
            waiting.append(node)
            if self.low <= node[0] < self.high:
                self.nodes[node[0], node[1]] = node[2]

    def finish(self) -> bytes | None:
        """The node at the top."""
        self.step(2 << self.high)
        return self.waiting[0][2]


def traverse(leaves: list[bytes], height: int, step: int = STEP) -> Iterator[tuple[list[bytes | None], bytes]]:
    """(path, root) of every leaf in turn: the nodes beside its own from the bottom up, None where a node is alone.

    ``height`` levels are climbed, of which the upper ones may have one node.
    """
    cuts = [(low, min(low + step, height)) for low in range(0, height, step)]
    first = [Treehash(leaves, low, high, 0) for low, high in cuts or [(0, 0)]]
    root = [tree.finish() for tree in first][-1]
    existing = [tree.nodes for tree in first]
    desired = [Treehash(leaves, low, high, 1) for low, high in cuts[:-1]]
    for at in range(len(leaves)):
        yield [existing[l // step][l, (at >> l) ^ 1] for l in range(height)], root
        for k, building in enumerate(desired):
            building.step(2)
            low, high = cuts[k]
            if (at + 1) & ((1 << high) - 1) == 0:
                building.finish()  # nothing is left to do but the top
                existing[k] = building.nodes
                desired[k] = Treehash(leaves, low, high, (at + 1 >> high) + 1)


def _climb(block: int, step: int):
    """Batches of (grp, block, pos, n, digest, row) sorted by the first three, to the same with path and top."""
    level = pa.struct([("digest", pa.string()), ("left", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["grp", "block"]):
            number = part.column("n")[0].as_py()
            first = part.column("pos")[0].as_py()
            height = min(block, (number - 1).bit_length())
            paths, tops = [], []
            for at, (path, root) in enumerate(traverse([d.encode() for d in part.column("digest").to_pylist()], height, step), first):
                paths.append([{"digest": None if d is None else d.decode(), "left": bool(at >> l & 1)} for l, d in enumerate(path)])
                tops.append(root.decode())
            made = part.append_column("path", pa.array(paths, pa.list_(level))).append_column("top", pa.array(tops, pa.string()))
            yield from made.combine_chunks().to_batches()

    return run


# --- the dataset ----------------------------------------------------------------------------------------------------


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos, the place from 0 in its ``grp`` by ``order``, and n, the number of nodes there; a written table.

    Rows are cut into ranges of (grp, order); a place is counted within a range, plus what the ranges before hold.
    """
    rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows, "ordered")
    part = F.shiftrightunsigned("_id", 33)
    runs = rows.groupBy("grp", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))  # one row a range and group
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("grp", "_part", "_first", before.alias("_before"), F.sum("_rows").over(group).alias("n")), "runs")
    met = rows.withColumn("_part", part).join(broadcast_if_small(runs), ["grp", "_part"])
    out = materialize(met.select(*nodes.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias("pos"), "n"), "placed")
    discard(rows)
    discard(runs)
    return out


def climbed(nodes: DataFrame, order: list[str], block: int = HEIGHT, step: int = STEP) -> DataFrame:
    """``nodes`` (grp binary, digest, row) with path, from the node to the root of its group, and root; a written table.

    ``row`` is any column that travels along; ``order`` are columns or fields of it.
    """
    at = placed(nodes, order).withColumn("block", F.shiftright("pos", block))
    kind = at.schema["row"].dataType.simpleString()
    by = ["grp", "block"]
    rows = at.select("grp", "block", "pos", "n", "digest", "row").repartition(*by).sortWithinPartitions(*by, "pos")
    rows = rows.mapInArrow(_climb(block, step), f"grp binary, block long, pos long, n long, digest string, row {kind}, path array<{LEVEL}>, top string")
    rows = materialize(rows, "climbed")
    discard(at)
    tops = rows.where(F.col("pos") == F.shiftleft("block", block)).select("grp", "block", F.col("top").alias("digest"), (F.col("n") > (1 << block)).alias("more"))
    if tops.where("more").isEmpty():
        return rows.select("grp", "digest", "row", "path", F.col("top").alias("root"))
    upper = climbed(tops.select("grp", "digest", F.struct("block").alias("row")), ["row.block"], block, step)
    upper = materialize(upper.select("grp", F.col("row.block").alias("block"), F.col("path").alias("_upper"), "root"), "upper")
    out = rows.join(broadcast_if_small(upper), by).select("grp", "digest", "row", F.concat("path", "_upper").alias("path"), "root")
    out = materialize(out, "paths")
    for old in (rows, upper):
        discard(old)
    return out


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, level: Column) -> Column:
        other = F.coalesce(level["digest"], F.lit(""))
        return F.sha2(F.when(level["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, start, up)


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None, block: int = HEIGHT, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``group``, leaf, path, subroot and root, and the columns ``also``.

    path has the nodes beside a row's own, from its leaf over its group's root (``subroot``) to the dataset's (``root``):
    ``fold(leaf, path)`` is root. Leaves ascend by ``key`` in their group, null keys first, rows of one key by leaf;
    groups by their UTF-8 bytes, the null group first and apart from the empty text. Repeated rows are a leaf each.
    Null fields, empty and long texts are leaves like any other; an empty table has no rows and no root. Only ``group``,
    ``key`` and ``fields`` are read; ``also`` may use them, too. ``key`` may be of any type that sorts, ``group`` of any
    that casts to text.
    """
    own = {"_key": F.col(key), "_group": F.col(group), "_leaf": leaf(*[F.col(f) for f in fields])} | (also or {})
    # null sorts before all, and apart from the empty text
    name = F.when(F.col(group).isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), F.col(group).cast("string").cast("binary")))
    leaves = docs.select(name.alias("grp"), F.struct(*[c.alias(n) for n, c in own.items()]).alias("row"))
    leaves = materialize(leaves.select("grp", F.col("row._leaf").alias("digest"), "row"), "leaves")
    trees = climbed(leaves, ["row._key", "digest"], block, step)
    roots = materialize(trees.groupBy("grp").agg(F.first("root").alias("digest")), "subroots")
    top = climbed(roots.select(F.lit(b"").alias("grp"), "digest", F.struct(F.col("grp").alias("of")).alias("row")), ["row.of"], block, step)
    top = materialize(top.select(F.col("row.of").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("_top"), F.col("root").alias("_root")), "tops")
    discard(leaves)
    discard(roots)
    out = trees.select("grp", "row", "path").join(broadcast_if_small(top), "grp")
    return out.select(F.col("row._key").alias(key), F.col("row._group").alias(group), F.col("row._leaf").alias("leaf"), F.concat("path", "_top").alias("path"), "subroot", F.col("_root").alias("root"), *[F.col(f"row.{n}").alias(n) for n in also or {}])


def siblings(path: Column) -> Column:
    """The digests of a path, one after the other."""
    return F.array_join(F.transform(path, lambda level: level["digest"]), "")
