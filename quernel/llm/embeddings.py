"""Near-duplicate vectors by randomised-rotation binary codes.

Every vector is stored once more as two codes of BITS bits a coordinate, one by each of two independent random
rotations, with a correction factor each: the inner product of the rotated vector with its code. A code divided by its
factor and rotated back is an unbiased estimate of the vector: its error has a known length and, rotations being random,
any direction across the vector. The inner product of one vector's first estimate with another's second is therefore an
unbiased estimate of their cosine, with a standard error that follows from the factors. Pairs whose estimate is more
than SPREAD standard errors under the threshold are settled; the others are open and are recomputed from the vectors.

Codes meet in tables, each keyed by which coordinates of further rotations are largest (``plan``); they travel to the
tables, vectors do not. A bucket yields the connections of its open pairs, one row a vector, never pairs. Vectors travel
once, to the group of those they are connected with, where every open pair is recomputed in double precision: this gives
links, their counts and the partial components at once. Equal vectors are one until the end, and buckets and groups of
over TILE vectors are cut into tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import connected_components, connecting_edges, groups, tiles, unite
from quernel.plans.storage import discard, materialize

COSINE = 0.93
LOST = 0.01  # links that tables are expected to lose in all, at most, of those that join components
BUCKET = 512  # vectors of the largest label that a bucket should hold
BITS = 3  # of a coordinate in a code
SPREAD = 6.5  # confidence bound in standard errors: 4e-11 of the pairs at exactly the threshold are over it
TILE = 4096
DENSE = 0.05  # share of open pairs from which rows are recomputed by one matrix product
ROUNDING = 1e-12  # by which a matrix product may be off a sum of products
TRIALS = 20_000  # random pairs by which a table's chance to bring a pair together is measured
SEED = 20240


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}  # those used in this process; a plain dict travels with the functions


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation, the same everywhere."""
    if (dim, k) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
        _ROTATIONS[dim, k] = q * np.where(np.diag(r) < 0, -1, 1)
    return _ROTATIONS[dim, k]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Finite non-zero rows at length 1 in double precision, also where squares would overflow or vanish."""
    x = x.astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- codes ----------------------------------------------------------------------------------------------------------


def encode(x: np.ndarray) -> list[bytes]:
    """Codes of unit rows: dimension, two correction factors, two codes."""
    n, dim = x.shape
    head = np.full((n, 1), dim, "<i4").view(np.uint8)
    factors, packed = [], []
    for k in range(2):
        y = x @ rotation(dim, k)
        step = 2 * np.abs(y).max(1, keepdims=True) / (1 << BITS)
        level = np.clip(np.floor(y / step), -(1 << BITS - 1), (1 << BITS - 1) - 1).astype(np.int64)
        factors.append(((level + 0.5) * y).sum(1, keepdims=True).astype("<f4"))
        bits = (level[..., None] + (1 << BITS - 1)) >> np.arange(BITS) & 1
        packed.append(np.packbits(bits.reshape(n, -1).astype(np.uint8), axis=1))
    rows = np.concatenate([head, np.concatenate(factors, 1).view(np.uint8), *packed], 1)
    return [r.tobytes() for r in rows]


def decode(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first estimates, second estimates, square of the error's length) of codes of one dimension."""
    dim = int.from_bytes(codes[0][:4], "little")
    rows = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    factors = np.ascontiguousarray(rows[:, 4:12]).view("<f4")
    width = (rows.shape[1] - 12) // 2
    estimates, error = [], np.zeros(len(codes))
    for k in range(2):
        bits = np.unpackbits(rows[:, 12 + k * width : 12 + (k + 1) * width], axis=1)[:, : dim * BITS].reshape(len(codes), dim, BITS)
        value = (bits @ (1 << np.arange(BITS)).astype(np.float32) - (1 << BITS - 1) + 0.5) / factors[:, k : k + 1]
        error = np.maximum(error, (value * value).sum(1) - 1)
        estimates.append(value.astype(np.float32) @ rotation(dim, k).T.astype(np.float32))
    return *estimates, np.maximum(error, 0)


def open_pairs(first: np.ndarray, second: np.ndarray, error: np.ndarray, rows: slice, cosine: float) -> np.ndarray:
    """Which pairs (rows by all) the estimates leave open: not under the threshold by over SPREAD standard errors."""
    estimate = (first[rows] @ second.T + second[rows] @ first.T) / 2
    e, f = error[rows, None], error[None, :]
    variance = ((1 - cosine**2) * (e + f) + e * f) / max(1, first.shape[1] - 1)
    return estimate >= (cosine - 1e-4 - SPREAD * np.sqrt(variance)).astype(np.float32)


# --- tables ---------------------------------------------------------------------------------------------------------


def chance(dim: int, part: int, cosine: float) -> float:
    """The chance that of two vectors of this cosine the same of ``part`` coordinates is largest, with the same sign.

    Measured on random pairs, less four standard errors.
    """
    rng = np.random.default_rng([SEED, dim, part, 1])
    trials = max(2000, min(TRIALS, (1 << 22) // dim))
    x, w = rng.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w -= (w * x).sum(1, keepdims=True) * x
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    y = (cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * w)[:, :part]
    x = x[:, :part]
    p = float((largest(x) == largest(y)).mean())
    return max(0.05, p - 4 * math.sqrt(p * (1 - p) / trials))


def largest(y: np.ndarray) -> np.ndarray:
    """Which coordinate is largest, and its sign, as one number."""
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] > 0)


def plan(vectors: int, dim: int, missed: float, cosine: float = COSINE) -> tuple[tuple[int, ...], int]:
    """(coordinates looked at by each part of a table's key, tables) for the largest label's number of vectors.

    A key has about vectors / BUCKET values, tables are as many as it takes that a pair at exactly the threshold is
    missed by all with the chance ``missed``. Up to BUCKET vectors one table holds every pair.
    """
    parts, wanted, p = [], vectors / BUCKET, 1.0
    while wanted > 1:
        part = min(dim, 1 << max(0, math.ceil(math.log2(wanted / 2))))
        parts.append(part)
        p *= chance(dim, part, cosine)
        wanted /= 2 * part
    return tuple(parts), 1 if not parts else math.ceil(math.log(missed) / math.log1p(-p))


def share_missed(vectors: int, lost: float = LOST) -> float:
    """Share of pairs that tables may miss, for ``lost`` links in all.

    Components are right once the links of any spanning forest are found, of which there are fewer than vectors; all
    other links inside a component are found when its vectors meet.
    """
    return min(1e-4, lost / max(1, vectors))


def keys(x: np.ndarray, parts: tuple[int, ...], tables: int) -> np.ndarray:
    """(vector, table): key of the bucket; the table is part of it."""
    n, dim = x.shape
    out = np.zeros((n, tables), np.int64)
    for t in range(tables):
        out[:, t] = t
        for k, part in enumerate(parts):
            out[:, t] = out[:, t] * (2 * part) + largest(x @ rotation(dim, 2 + t * len(parts) + k)[:, :part])
    return out


def _vectors(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column in one piece and the lengths of its rows."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole, whole.value_lengths().to_numpy(zero_copy_only=False)


def _encode(plans: dict[int, tuple[tuple[int, ...], int]]):
    """Batches of (node, v) to node, code and keys, one a table of the vector's dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                whole, lengths = _vectors(part.column(1))
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    x = unit_rows(whole.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))
                    found = keys(x, *plans[int(dim)])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(encode(x), pa.binary()), lists], names=["node", "code", "keys"])

    return run


def _open(cosine: float):
    """Connections (a, b) of the open pairs of each bucket or tile of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["label", "key", "tile_a", "tile_b"]):
            if group.num_rows < 2:
                continue
            codes = group.column("code").to_pylist()
            node, block = group.column("node").to_numpy(), group.column("block").to_numpy()
            first, second, error = decode(codes)
            across = (block != block[0]).any()
            labels = np.arange(len(codes))
            for i in range(0, len(codes), 256):
                maybe = open_pairs(first, second, error, slice(i, i + 256), cosine)
                if across:
                    maybe &= block[i : i + 256, None] != block[None, :]
                a, b = np.nonzero(np.triu(maybe, i + 1))
                if len(a):
                    labels = unite(labels, a + i, b)
            linked = np.flatnonzero(labels != np.arange(len(codes)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])

    return run


def _judge(cosine: float):
    """Links within groups: (node, links, first), the number of vectors linked in this tile and one of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["root", "tile_a", "tile_b"]):
            if group.num_rows < 2:
                continue
            whole, lengths = _vectors(group.column("v"))
            # vectors of different labels or lengths have no link; hashes of labels may agree
            kind = np.unique(np.array([f"{n}:{label}" for n, label in zip(lengths, group.column("name").to_pylist())]), return_inverse=True)[1]
            for k in range(kind.max() + 1):
                at = np.flatnonzero(kind == k)
                if len(at) < 2:
                    continue
                take = pa.array(at)
                x = unit_rows(whole.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                node, block, copies = (group.column(c).to_numpy()[at] for c in ("node", "block", "copies"))
                first, second, error = decode(group.column("code").combine_chunks().take(take).to_pylist())
                across = (block != block[0]).any()
                labels, links = np.arange(len(x)), np.zeros(len(x), np.int64)
                for i in range(0, len(x), 256):
                    rows = slice(i, i + 256)
                    maybe = np.triu(open_pairs(first, second, error, rows, cosine), i + 1)
                    if across:
                        maybe &= block[rows, None] != block[None, :]
                    if maybe.mean() > DENSE:  # only those at the threshold are left for the formula below, which decides
                        product = x[rows] @ x.T
                        sure = maybe & (product >= cosine + ROUNDING)
                        maybe &= np.abs(product - cosine) < ROUNDING
                    else:
                        sure = np.zeros_like(maybe)
                    a, b = np.nonzero(maybe)
                    near = np.concatenate([np.einsum("ij,ij->i", x[a[j : j + 16384] + i], x[b[j : j + 16384]]) >= cosine for j in range(0, len(a), 16384)] or [np.zeros(0, bool)])
                    sure[a[near], b[near]] = True
                    a, b = np.nonzero(sure)
                    if len(a):
                        links += np.bincount(a + i, copies[b], minlength=len(x)).astype(np.int64) + np.bincount(b, copies[a + i], minlength=len(x)).astype(np.int64)
                        open_ = labels[a + i] != labels[b]
                        labels = unite(labels, a[open_] + i, b[open_])
                linked = np.flatnonzero(links)
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(links[linked]), pa.array(node[labels[linked]])], names=["node", "links", "first"])

    return run


def valid(vector: str = "embedding"):
    """Whether a vector can have a cosine, told in the JVM."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, vector: str = "embedding", cosine: float = COSINE, missed: float | None = None, tile: int = TILE) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept; other columns are not read.

    Vectors are compared only within equal labels. Vectors with a null label, or null, empty, zero, or with a null or
    non-finite component, link with nothing, as do rows without vec_id, whose component_id is null and kept false.
    Equal vectors of a label are linked. Vectors of different lengths have no cosine. Of rows that repeat a vec_id
    each comes out and counts as a vector of its own. ``missed`` is that of ``plan``; without it, ``share_missed``.
    An empty table gives an empty result.
    """
    element = df.schema[vector].dataType.elementType
    good = valid(vector) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # zeros of either sign are one value
    same = F.transform(vector, lambda x: x + F.lit(0).cast(element))
    name = F.col("label").cast("string")
    # label and vector are told by 128 bits where rows are sent back to them
    told = {"one": F.xxhash64(name, same), "two": F.xxhash64(F.lit(1), name, same)}
    rows = df.select("vec_id", F.when(good, name).alias("name"), F.when(good, same).alias("v"), *[F.when(good, h).alias(k) for k, h in told.items()])
    nodes = rows.where("name is not null").groupBy("name", "v", "one", "two").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # rows may repeat a vec_id
    sizes = nodes.groupBy("name", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("every")).collect()  # one row a dimension
    every = sum(r["every"] for r in sizes)
    plans = {r["dim"]: plan(r["most"], r["dim"], share_missed(every) if missed is None else missed, cosine) for r in sizes}
    codes = materialize(nodes.select("node", "v").mapInArrow(_encode(plans), "node long, code binary, keys array<long>"), "codes")
    labelled = codes.join(nodes.select("node", F.xxhash64("name").alias("label")), "node")
    placed = labelled.select("node", "code", "label", F.explode("keys").alias("key"))

    def judge(met: DataFrame) -> DataFrame:
        by = ["label", "key", "tile_a", "tile_b"]
        return met.select("node", "code", "block", *by).repartition(*by).sortWithinPartitions(*by).mapInArrow(_open(cosine), "a long, b long")

    near = materialize(connected_components(connecting_edges(placed, ["label", "key"], "node", tile, judge)), "near")
    members = codes.select("node", "code").join(near, "node").join(nodes.select("node", "name", "v", "copies"), "node")
    by = ["root", "tile_a", "tile_b"]
    met = tiles(materialize(members, "members"), ["root"], F.col("node"), tile).repartition(*by).sortWithinPartitions(*by)
    found = materialize(met.mapInArrow(_judge(cosine), "node long, links long, first long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = materialize(connected_components(found.select(F.col("node").alias("a"), F.col("first").alias("b"))).join(nodes.select("node", "id"), "node"), "joined")
    least = joined.groupBy("root").agg(F.min("id").alias("least"))
    facts = nodes.select("node", "id", "one", "two", "copies").join(counts, "node", "left").join(joined.select("node", "root").join(least, "root"), "node", "left")
    facts = materialize(facts.select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id")), "facts")
    for old in (nodes, codes, near, found, joined):
        discard(old)
    out = rows.select("vec_id", "one", "two").join(facts, ["one", "two"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
