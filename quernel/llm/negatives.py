"""Hard negatives by inner product, from a pivot table.

Vectors are scaled and cut to whole numbers. With M the greatest length, every vector x gets one more coordinate,
sqrt(M^2 - |x|^2), and an anchor q the coordinate 0: then |q - x|^2 = |q|^2 + M^2 - 2 * (q * x), so that a high inner
product is a short distance. The pivot table has, with every vector, its distances from a few pivots; by the triangle
inequality an anchor's distances from the pivots bracket its distance from a vector, and hence the score, from both
sides. Rows of the table lie in blocks, cut into cells of one label and alike distances, which are bracketed as a whole
first. What the brackets leave open is computed exactly, in whole numbers.

Anchors, a stated part of the rows, meet all blocks of the table, in blocks of their own: first to find their best
positives, then the best negatives in the score range of each positive. Every task keeps the best of what it has seen,
and hands on no more than those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import broadcast_if_small, groups
from quernel.plans.storage import discard, materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative's score, in hundredths of its positive's
PIVOTS = 16
SAMPLE = 1000  # rows that pivots are chosen from, those with the smallest hash of their id
BLOCK = 4096  # vectors of a block of the table, at most
CELL = 64  # vectors of a cell, at most
ANCHORS = 1024  # of a block of anchors, about
HELD = 1 << 16  # anchors whose best a task keeps before it hands them on
_WIDTHS = ("<i2", "<i4", "<i8")


# --- pivots ---------------------------------------------------------------------------------------------------------


def augment(x: np.ndarray, square: float) -> np.ndarray:
    """``x`` with the coordinate that brings all rows to the length sqrt(``square``)."""
    x = x.astype(float)
    rest = np.sqrt(np.maximum(square - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(row, pivot): Euclidean distances."""
    out = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def choose_pivots(x: np.ndarray, number: int) -> np.ndarray:
    """Of augmented rows the first, and then that farthest from those chosen, in turn."""
    if not len(x):
        return x
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < number and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def bracket(q: np.ndarray, low: np.ndarray, high: np.ndarray, square: float, q_square: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that rows may have whose distances from the pivots are from ``low`` to ``high``, one row each.

    ``q`` are the anchor's distances. Wider by what rounding may do.
    """
    whole = q_square + square
    slack = 1 + 1e-5 * whole
    if not low.shape[1]:
        return np.full(len(low), -np.inf), np.full(len(low), np.inf)
    nearest = np.maximum(np.maximum(q - high, low - q), 0).max(1)
    farthest = (q + high).min(1)
    return (whole - farthest**2) / 2 - slack, (whole - nearest**2) / 2 + slack


# --- blocks ---------------------------------------------------------------------------------------------------------


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """The smallest of the three widths that holds ``x``, and its bytes."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    width = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return width, x.astype(_WIDTHS[width]).tobytes()


def wide(width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, _WIDTHS[width]).reshape(rows, -1).astype(np.int64)


_BLOCK = "dim int, square double, width int, ids binary, vectors binary, near binary, names array<string>, counts array<int>"


def pivot_table(plans: dict[int, tuple[np.ndarray, float]], block: int):
    """Batches of (id, name, v) to blocks of vectors of one dimension, by label and then by distance from the nearest pivot."""

    def packed(dim: int, held: list[tuple]) -> pa.RecordBatch:
        ids, names, x = (np.concatenate(c) for c in zip(*held))
        pivots, square = plans[dim]
        near = distances(augment(x, square), pivots).astype("<f4") if len(pivots) else np.zeros((len(x), 0), "<f4")
        kinds, code = np.unique(names, return_inverse=True)
        order = np.lexsort((near.min(1), near.argmin(1), code)) if len(pivots) else np.argsort(code, kind="stable")
        width, vectors = narrow(x[order])
        row = [[dim], [float(square)], [width], [ids[order].astype("<i8").tobytes()], [vectors], [near[order].tobytes()], [kinds.tolist()], [np.bincount(code).tolist()]]
        kind = [pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kind)], names=[f.split()[0] for f in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            ids, names = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            for dim in np.unique(lengths).tolist():
                every = np.flatnonzero(lengths == dim)
                for k in range(0, len(every), block):
                    at = every[k : k + block]
                    x = batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                    if size.get(dim, 0) + len(at) > block:
                        yield packed(dim, held.pop(dim))
                        size[dim] = 0
                    held.setdefault(dim, []).append((ids[at], names[at], x))
                    size[dim] = size.get(dim, 0) + len(at)
        for dim in list(held):
            yield packed(dim, held.pop(dim))

    return run


_ANCHORS = "ab int, dim int, own_width int, own_ids binary, own_vectors binary, own_names array<string>, own_wanted binary"


def _anchor_blocks(positives: int):
    """Batches of (ab, id, name, v, wanted) sorted by ab to one row a block and dimension.

    ``wanted``: id and score of each positive, in pairs; padded by pairs with the score of None, told by their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["ab"]):
            part = part.combine_chunks()
            lists = part.column("v").combine_chunks()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == dim))
                width, vectors = narrow(lists.take(at).flatten().to_numpy().reshape(len(at), dim))
                wanted = np.zeros((len(at), 1 + 2 * positives), "<i8")
                for k, pairs in enumerate(part.column("wanted").take(at).to_pylist()):
                    wanted[k, 0] = len(pairs)
                    wanted[k, 1 : 1 + 2 * len(pairs)] = [x for p in pairs for x in (p["id"], p["score"])]
                row = [[part.column("ab")[0].as_py()], [dim], [width], [part.column("id").take(at).to_numpy().astype("<i8").tobytes()], [vectors], [part.column("name").take(at).to_pylist()], [wanted.tobytes()]]
                kind = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kind)], names=[f.split()[0] for f in _ANCHORS.split(", ")])

    return run


class Block:
    """A block of the pivot table that anchors meet."""

    def __init__(self, row: dict, cell: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = wide(row["width"], row["vectors"], len(self.ids)) if row["dim"] else np.zeros((len(self.ids), 0), np.int64)
        self.near = np.frombuffer(row["near"], "<f4").reshape(len(self.ids), -1).astype(float)
        self.square, self.names = row["square"], row["names"]
        ends = np.cumsum(row["counts"])
        self.label = np.repeat(np.arange(len(ends)), row["counts"])
        # cells end where labels do
        self.begin = np.concatenate([np.arange(a, b, cell) for a, b in zip(ends - row["counts"], ends)])
        self.size = np.diff(np.append(self.begin, len(self.ids)))
        self.cell_label = self.label[self.begin]
        self.low, self.high = (f.reduceat(self.near, self.begin, axis=0) for f in (np.minimum, np.maximum))
        self.most = max(int(self.x.max(initial=0)), -int(self.x.min(initial=0)))
        self.real = self.x.astype(float)

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """Rows of some cells."""
        size = self.size[cells]
        return np.repeat(self.begin[cells] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        bound = self.x.shape[1] * self.most * int(np.abs(q).max(initial=0))
        if bound < 1 << 53:  # products and sums of whole numbers under 2^53 are exact
            return (self.real[rows] @ q.astype(float)).astype(np.int64)
        if bound < 1 << 63:
            return self.x[rows] @ q
        raise OverflowError("inner products have more than 64 bits")


def best(ids: np.ndarray, scores: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ids and scores the ``number`` highest scores, ties by the smaller id."""
    if len(ids) > 4 * number:
        least = np.partition(scores, len(scores) - number)[len(scores) - number]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:number]
    return ids[order], scores[order]


def positives_of(block: Block, label: int, anchor: int, q: np.ndarray, near: np.ndarray, held: tuple[np.ndarray, np.ndarray], number: int) -> tuple[np.ndarray, np.ndarray]:
    """``held`` with the rows of the anchor's label in ``block`` that are among the best ``number``."""
    ids, scores = held
    cells = np.flatnonzero(block.cell_label == label)
    q_square = float((q.astype(float) ** 2).sum())
    most = bracket(near, block.low[cells], block.high[cells], block.square, q_square)[1]
    order = np.argsort(-most)
    cells, most = cells[order], most[order]
    for k in range(0, len(cells), 4):
        floor = scores[-1] if len(scores) == number else -np.inf
        if most[k] < floor:
            break
        rows = block.rows(cells[k : k + 4])
        rows = rows[(block.ids[rows] != anchor) & (bracket(near, block.near[rows], block.near[rows], block.square, q_square)[1] >= floor)]
        ids, scores = best(np.append(ids, block.ids[rows]), np.append(scores, block.scores(rows, q)), number)
    return ids, scores


def negatives_of(block: Block, label: int, q: np.ndarray, near: np.ndarray, ranges: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], number: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``held``, by score range (from, to), with the rows of other labels in ``block`` that are among its best ``number``."""
    floor = np.array([max(r[0], s[-1]) if len(s) == number else r[0] for r, (_, s) in zip(ranges, held)])
    open_ = lambda least, most: ((most[:, None] >= floor) & (least[:, None] <= ranges[:, 1]) & (floor <= ranges[:, 1])).any(1)
    q_square = float((q.astype(float) ** 2).sum())
    cells = np.flatnonzero(block.cell_label != label)
    cells = cells[open_(*bracket(near, block.low[cells], block.high[cells], block.square, q_square))]
    rows = block.rows(cells)
    rows = rows[open_(*bracket(near, block.near[rows], block.near[rows], block.square, q_square))]
    if not len(rows):
        return held
    found, ids = block.scores(rows, q), block.ids[rows]
    out = []
    for (low, high), least, (i, s) in zip(ranges.tolist(), floor.tolist(), held):
        fit = (found >= least) & (found <= high)
        out.append(best(np.append(i, ids[fit]), np.append(s, found[fit]), number) if fit.any() else (i, s))
    return out


def score_range(positive: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _search(pivots: dict[int, np.ndarray], cell: int, positives: int, negatives: int | None, low: int, high: int):
    """Batches of blocks met with blocks of anchors to (anchor, positive, positive_score, id, score), the best that the task has seen.

    Without ``negatives`` these are positives, and ``positive`` and its score are 0.
    """

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for anchor, (wanted, found) in held.items():
            each = [(anchor, p, s, i, score) for (p, s), (ids, scores) in zip(wanted, found) for i, score in zip(ids.tolist(), scores.tolist())]
            if each:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*each)], names=["anchor", "positive", "positive_score", "id", "score"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                block = Block(row, cell)
                own = np.frombuffer(row["own_ids"], "<i8").tolist()
                q = wide(row["own_width"], row["own_vectors"], len(own)) if row["dim"] else np.zeros((len(own), 0), np.int64)
                at = pivots.get(row["dim"])
                near = distances(np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1), at) if at is not None and len(at) else np.zeros((len(q), 0))
                code = {n: k for k, n in enumerate(block.names)}
                pairs = np.frombuffer(row["own_wanted"], "<i8").reshape(len(own), -1)
                for k, anchor in enumerate(own):
                    label = code.get(row["own_names"][k], -1)
                    if negatives is None:
                        wanted, found = held.get(anchor, ([(0, 0)], [_NONE]))
                        if label >= 0:
                            found = [positives_of(block, label, anchor, q[k], near[k], found[0], positives)]
                    else:
                        wanted = [tuple(pairs[k, 1 + 2 * j : 3 + 2 * j].tolist()) for j in range(pairs[k, 0])]
                        found = held.get(anchor, (wanted, [_NONE] * len(wanted)))[1]
                        ranges = np.array([score_range(s, low, high) for _, s in wanted], np.int64).reshape(-1, 2)
                        found = negatives_of(block, label, q[k], near[k], ranges, found, negatives)
                    held[anchor] = wanted, found
                if len(held) > HELD:
                    yield from flush(held)
        yield from flush(held)

    return run


# --- the search -----------------------------------------------------------------------------------------------------


def usable(vector: str, label: str, key: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(v.isNotNull() & finite, F.lit(False))


def hard_negatives(df: DataFrame, anchors: Column, vector: str = "embedding", label: str = "label", key: str = "vec_id", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, number: int = PIVOTS, block: int = BLOCK, cell: int = CELL, together: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its positives the best negatives.

    Components are floor(SCALE * x), scores inner products, higher ones first, ties by the smaller id. An anchor's
    positives are the best ``positives`` rows of its label with another id; a positive's negatives the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.

    Rows whose id, label or vector is null, or with a null or non-finite component, take no part; vectors of different
    lengths have no score; zero vectors score 0. Rows that repeat an id are candidates each; as an anchor, the first by
    label and vector stands for them. Anchors without positives, and positives without negatives, have no rows; an
    empty table gives none. Inner products of more than 64 bits are an error. Only the three columns, and what
    ``anchors`` names, are read.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.where(usable(vector, label, key)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("name"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("own"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("square")).collect()  # one row a dimension
    square = {r["dim"]: r["square"] * (1 + 1e-9) for r in facts}
    some: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE).select("v").collect():
        some.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {dim: choose_pivots(augment(np.array(some[dim], float).reshape(len(some[dim]), dim), square[dim]), number) if dim in some else np.zeros((0, dim + 1)) for dim in square}
    table = rows.select("id", "name", "v").mapInArrow(pivot_table({d: (pivots[d], square[d]) for d in square}, block), _BLOCK)
    table = materialize(table, "pivot-table")
    own = rows.where("own").groupBy("id").agg(F.min(F.struct("name", "v")).alias("r")).select("id", "r.name", "r.v")
    own = materialize(own, "anchors")
    blocks = max(1, -(-own.count() // together))
    written = [table, own]

    def meet(anchor_rows: DataFrame, most: int | None) -> DataFrame:
        placed = anchor_rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("ab"), "id", "name", "v", "wanted")
        own_blocks = materialize(placed.repartition("ab").sortWithinPartitions("ab").mapInArrow(_anchor_blocks(positives), _ANCHORS), "anchor-blocks")
        written.append(own_blocks)
        met = table.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(broadcast_if_small(own_blocks), ["ab", "dim"])
        return met.mapInArrow(_search(pivots, cell, positives, most, low, high), "anchor long, positive long, positive_score long, id long, score long")

    def first(found: DataFrame, by: list[str], number: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= number)

    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    found = materialize(first(meet(own.withColumn("wanted", none), None), ["anchor"], positives), "positives")
    wanted = found.groupBy(F.col("anchor").alias("id")).agg(F.collect_set(F.struct("id", "score")).alias("wanted"))  # few a row
    asked = own.join(broadcast_if_small(wanted), "id")
    out = first(meet(asked, negatives), ["anchor", "positive", "positive_score"], negatives)
    out = materialize(out, "negatives")
    for old in (*written, found):
        discard(old)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
