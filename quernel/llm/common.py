"""What the operators share: columns computed over Arrow batches, tiles of hot groups, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.plans.storage import discard, materialize

ROWS = 256  # texts held at once by a Python worker


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def append_columns(df: DataFrame, start: Callable[[], Callable], fields: list[T.StructField], source: str = "text", keep_source: bool = True, where: Callable | None = None) -> DataFrame:
    """``df`` with columns computed from ``source``; existing columns of those names are replaced.

    ``start()`` runs once a task and returns a function from a list of texts (None for null) to one list for each of
    ``fields``. Rows stay where they are: no shuffle, at most ROWS texts in Python at a time. ``where`` gets the new
    lists and returns a mask of rows to keep.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    base = df.select(*[df[f"`{c}`"] for c in kept])
    out = T.StructType([f for f in base.schema.fields if keep_source or f.name != source] + fields)
    arrow = to_arrow_schema(out)
    at = kept.index(source)
    others = [i for i, c in enumerate(kept) if keep_source or c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                values = work(part.column(at).to_pylist())
                arrays = [part.column(i) for i in others]
                arrays += [pa.array(v, type=f.type) for v, f in zip(values, list(arrow)[len(others) :])]
                made = pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow)], schema=arrow)
                yield made if where is None else made.filter(pa.array(where(*values), type=pa.bool_()))

    return base.mapInArrow(run, out)


def tiles(df: DataFrame, keys: list[str], item: Column, most: int) -> DataFrame:
    """Split groups of over ``most`` rows into tiles, so that no task ever holds more than about twice that many.

    A group of n rows is cut into b = ceil(n / most) blocks; every pair of blocks is a tile, and each row goes to the
    b tiles of its block. Every two rows of a group meet in a tile; ``tile_a`` = ``tile_b`` marks a block met with
    itself. Without such groups the columns are 0 and no row moves.
    """
    hot = materialize(df.groupBy(*keys).count().where(F.col("count") > most), "hot")
    if hot.isEmpty():
        return df.withColumns({"block": F.lit(0), "tile_a": F.lit(0), "tile_b": F.lit(0)})
    blocks = hot.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    cut = df.join(blocks, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumns({"tile_a": F.least("block", "other"), "tile_b": F.greatest("block", "other")}).drop("blocks", "other")


def connecting_edges(df: DataFrame, keys: list[str], node: str, most: int, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that connect what is linked within groups of ``keys``, of whatever size.

    ``judge`` takes rows with ``tile_a``, ``tile_b`` and ``block`` and returns the edges found within each tile: between
    rows of different blocks, or between all rows if there is one block. Groups of up to ``most`` rows are one tile.
    Larger ones are cut into blocks of about ``most`` rows. Every block first meets block 0, which costs as much as the
    group has rows. Mostly one component then holds nearly all of the group, and pairs within it need no look: only the
    rows left out of it still meet all the others, in tiles.
    """
    one = {"tile_a": F.lit(0), "tile_b": F.lit(0), "block": F.lit(0)}
    hot = materialize(df.groupBy(*keys).count().where(F.col("count") > most), "hot")
    if hot.isEmpty():
        return judge(df.withColumns(one))
    blocks = hot.select(*keys, F.ceil(F.col("count") / most).cast("int").alias("_blocks"))
    cut = df.join(blocks, keys, "left").withColumn("_own", F.pmod(F.xxhash64(node), F.coalesce("_blocks", F.lit(1))).cast("int"))
    everywhere = F.when(F.col("_own") == 0, F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)).otherwise(F.array("_own"))
    first = cut.withColumn("tile_b", F.explode(everywhere)).withColumns({"tile_a": F.lit(0), "block": F.lit(0)}).drop("_blocks", "_own")
    edges = materialize(judge(first), "edges")
    roots = connected_components(edges)
    members = cut.where("_blocks is not null").select(*keys, node, "_blocks", "_own").join(roots.withColumnRenamed("node", node), node, "left")
    members = materialize(members.withColumn("_label", F.coalesce("root", node)), "members")
    largest = members.groupBy(*keys, "_label").count().groupBy(*keys).agg(F.max_by("_label", F.struct("count", "_label")).alias("_main"))
    rest = materialize(members.join(largest, keys).where("_label <> _main").select(*keys, node, "_blocks"), "rest")
    if rest.isEmpty():
        return edges
    turns = materialize(rest.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_turns")), "turns")
    every = cut.join(turns, keys).withColumn("tile_a", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    every = every.withColumns({"tile_b": F.col("_own"), "block": F.lit(0)}).drop("_blocks", "_own", "_turns")
    out = df.join(rest, [*keys, node]).join(turns, keys).withColumn("tile_a", F.pmod(F.xxhash64(node, F.lit(1)), F.col("_turns")).cast("int"))
    out = out.withColumn("tile_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("block", F.lit(1)).drop("_blocks", "_turns")
    return edges.unionByName(judge(every.unionByName(out)))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` from batches sorted by them, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of positions a[i] and b[i]; labels[x] is the smallest position of x's set."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps. Each step is a written table, so lost executors cost one step, and the
    hub of a star is met by a join between two written tables, which adaptive execution can split.
    """
    star = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        ends = star.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = materialize(ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v"), "least")
        large = materialize(star.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialize(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (star, least, large):
            discard(old)
        star = following


BROADCAST_BYTES = 32 << 20  # of a table that goes to every executor, at most
ROW_BYTES = 48  # that a row of a few numbers is taken to have in memory besides its texts


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the hint to send it to all executors if its rows, as counted, have ``most`` bytes; else a join shuffles it.

    Texts and arrays count by their length. ``df`` should be a written table, or cheap to read twice.
    """
    sizes = [F.coalesce(F.length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes += [F.coalesce(F.length(F.to_json(f"`{f.name}`")), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    every = F.lit(ROW_BYTES + 8 * len(df.columns))
    for size in sizes:
        every = every + size
    total = df.agg(F.coalesce(F.sum(every.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for null ids."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def class_sample(df: DataFrame, by: str, key: str, per_class: int, most_classes: int = 1000) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, those with the smallest hash of ``key``; all rows of rarer values.

    Rates come from counts over all rows, so the sample is one filter over the scan: nothing is sorted or shuffled.
    """
    counts = df.groupBy(by).count().limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        raise ValueError(f"{by} has over {most_classes} values")
    if not counts:
        return df
    rates = F.create_map(*[x for r in counts for x in (F.lit(r[by]), F.lit(min(1.0, per_class / r["count"])))])
    unit = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    return df.where(unit < F.element_at(rates, F.col(by)))
