"""Curation: validity, ordered de-duplication, leakage removal, sampling, diversity and mixing.

Samples are ranked by a hash of seed and key instead of a generator's state: the same rows on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import strip
from quernel.plans.storage import discard, materialize

FEW = 100_000  # rows of a side table up to which it is sent to every executor
ROLES = ("system", "user", "assistant")


def hash_rank(key: Column, seed: int) -> Column:
    """A deterministic random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def _rows(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one column ``_row``, and columns beside it whose names can't clash with its own."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in more.items()])


def shuffle_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with rank, the place from 0 in the seeded shuffle; null keys come first.

    Ranks are counted within the 4,096 ranges of the hash's first digits, plus what the ranges before hold.
    """
    rows = _rows(df, h=F.coalesce(hash_rank(F.col(key), seed), F.lit("")), key=F.col(key)).withColumn("range", F.substring("h", 1, 3))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("h", "key")) - 1
    return rows.withColumn("within", within).join(F.broadcast(starts), "range").select("_row.*", (F.col("start") + F.col("within")).alias("rank"))


def reject_reason(messages: Column, metadata: Column | None = None, roles: tuple[str, ...] = ROLES) -> Column:
    """Why a conversation is not valid; null if it is."""
    seen = F.transform(messages, lambda m: m["role"])
    reason = (
        F.when(messages.isNull(), "no conversation")
        .when(F.size(messages) != len(roles), "wrong number of messages")
        .when(~F.coalesce(seen == F.array(*map(F.lit, roles)), F.lit(False)), "wrong roles")
        .when(F.exists(messages, lambda m: F.coalesce(strip(m["content"]) == "", F.lit(True))), "blank content")
    )
    return reason if metadata is None else reason.when(metadata.isNull(), "no metadata")


def only_text(messages: Column, role: str) -> Column:
    """The content of the one message of ``role``; null unless there is exactly one."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(own) == 1, F.get(own, F.lit(0))["content"])


def dedup_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows of one key that which comes first by ``order``; null keys are one key. The key is hashed, so rows shuffle on few bytes."""
    w = Window.partitionBy("key").orderBy("order")
    rows = _rows(df, key=F.sha2(key, 256), order=F.col(order))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("_row.*")


def exclude(df: DataFrame, blocked: DataFrame, key: Column, blocked_key: Column) -> DataFrame:
    """Rows whose key is in none of the blocked rows; null keys are never blocked."""
    keys = blocked.select(F.sha2(blocked_key, 256).alias("key")).distinct()
    return _rows(df, key=F.sha2(key, 256)).join(keys, "key", "left_anti").select("_row.*")


def overlap_counts(df: DataFrame, split: str, key: str, names: tuple[str, ...]) -> DataFrame:
    """For each pair of splits: distinct keys in both, and in either alone. One aggregation by key, none by pair."""
    per_key = df.groupBy(key).agg(*[F.max((F.col(split) == n).cast("int")).alias(f"in_{n}") for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    aggs = []
    for a, b in pairs:
        x, y = F.col(f"in_{a}"), F.col(f"in_{b}")
        aggs += [F.sum(x * y).alias(f"{a}_{b}_both"), F.sum(x * (1 - y)).alias(f"{a}_{b}_left"), F.sum((1 - x) * y).alias(f"{a}_{b}_right")]
    rows = [F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"{a}_{b}_both").alias("both"), F.col(f"{a}_{b}_left").alias("left_only"), F.col(f"{a}_{b}_right").alias("right_only")) for a, b in pairs]
    return per_key.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _quotas(df: DataFrame, stratum: str, target: int, half_even: bool) -> DataFrame:
    """(stratum, n, total, quota) by the strata's sizes; strata are few, rows are not sorted here."""
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    share = F.lit(target).cast("double") * F.col("n") / F.col("total")
    return sizes.join(F.broadcast(total)).withColumn("quota", (F.bround(share) if half_even else F.floor(share)).cast("long"))


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` with the hint to send it to all executors if it has few rows, as counted; else it is met by a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to three tasks a core.

    For narrow tables whose rows cost far more to work on than to read: a file of a few MB is one task else.
    """
    return df.repartition(max(12, 3 * df.sparkSession.sparkContext.defaultParallelism), key)


def _unit(rank: Column) -> Column:
    """The first 48 bits of a hash in hex digits as a number from 0 to 1."""
    return F.conv(F.substring(rank, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _ranked(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """(_row, stratum, key, rank) of ``df``; rows without a key come first."""
    return _rows(df, stratum=F.col(stratum), key=F.col(key), rank=F.coalesce(hash_rank(F.col(key), seed), F.lit("")))


def _meet(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined with a few rows by stratum; the null stratum is one like any other."""
    side = side.withColumnRenamed("stratum", "own")
    return rows.join(small(side), rows["stratum"].eqNullSafe(side["own"]), how).drop("own")


def _lowest(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """Of each stratum its first ``quota`` rows by rank: a written table.

    Only rows whose hash is under a bound that ``quota`` rows of ``n`` pass almost surely are ranked, so that no stratum
    is sorted as a whole; should a bound be too low, all rows are.
    """
    met = _meet(rows, quotas.select("stratum", "n", "quota"))
    bound = (F.col("quota") + 8 * F.sqrt("quota") + 32) / F.col("n")
    order = Window.partitionBy("stratum").orderBy("rank", "key")
    wanted = quotas.agg(F.coalesce(F.sum(F.least("quota", "n")), F.lit(0))).first()[0]
    for some in (met.where((F.col("quota") > 0) & (F.coalesce(_unit(F.col("rank")), F.lit(0.0)) <= bound)), met):
        out = materialize(some.withColumn("place", F.row_number().over(order)).where("place <= quota").drop("place", "n", "quota"), "lowest")
        if out.count() == wanted:
            return out
        discard(out)
    raise ValueError(f"{wanted} rows were wanted of the strata")


def stratified_floor(df: DataFrame, stratum: str, key: str, target: int, seed: int) -> DataFrame:
    """Floor quotas by stratum, null being one; what is missing of ``target`` is filled from all leftovers by rank.

    Exactly ``target`` rows; an error if there are fewer, or if keys that repeat leave fewer. Columns keep their names.
    """
    quotas = materialize(_quotas(df, stratum, target, False), "quotas")
    told = quotas.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("quota"), F.lit(0)).alias("quota")).first()
    if told["rows"] < target:
        raise ValueError("the target exceeds the rows")
    rows = _ranked(df, stratum, key, seed)
    own = _lowest(rows, quotas)
    last = own.groupBy("stratum").agg(F.max(F.struct("rank", "key")).alias("last"))
    rest = _meet(rows, last, "left").where(F.col("last").isNull() | (F.struct("rank", "key") > F.col("last")))
    short = target - told["quota"]  # fewer than there are strata
    filled = materialize(rest.orderBy("rank", "key").limit(short).select("_row"), "filled")
    if filled.count() < short:
        raise ValueError("keys repeat: the leftovers don't fill the target")
    return own.select("_row.*").unionByName(filled.select("_row.*"))


def stratified_round(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """Half-even quotas, each capped by what is left; the stratum last by name takes all that remains. Null is a stratum, the first.

    All rows if ``size`` is not below their number; an error if the last stratum has fewer rows than remain.
    """
    quotas = _quotas(df, stratum, size, True)
    order = Window.orderBy("stratum")  # one row a stratum
    before = F.least(F.lit(size), F.coalesce(F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.lead(F.lit(1)).over(order).isNull()
    left = F.lit(size) - before
    quotas = materialize(quotas.withColumn("take", F.when(last, left).otherwise(F.least("quota", left))), "quotas")
    told = quotas.agg(F.max("total").alias("total"), F.coalesce(F.bool_or(F.col("take") > F.col("n")), F.lit(False)).alias("too_few")).first()
    if told["total"] is None or size >= told["total"]:
        return df
    if told["too_few"]:
        raise ValueError("the last stratum is too small")
    return _lowest(_ranked(df, stratum, key, seed), quotas.select("stratum", "n", F.col("take").alias("quota"))).select("_row.*")


def select_prompts(rows: DataFrame, blocked: list[DataFrame], key: str, order: str, count: int, seed: int) -> DataFrame:
    """``count`` rows with ``group_id``: the first by ``order`` of each key that is in none of the blocked frames, by rank of the key.

    ``key`` may be text or an array (a sorted attribute key). An error if fewer keys are left.
    """
    whole = F.to_json(F.struct(key))
    pool = rows
    if blocked:
        keys = blocked[0].select(key)
        for more in blocked[1:]:
            keys = keys.unionByName(more.select(key))
        pool = exclude(pool, keys, whole, whole)
    pool = materialize(_rows(dedup_first(pool, whole, order), rank=hash_rank(whole, seed), group=F.sha2(whole, 256)), "pool")
    left = pool.count()
    if left < count:
        raise ValueError(f"only {left} keys are left of {count}")
    return pool.orderBy("rank").limit(count).select("_row.*", F.substring("group", 1, 16).alias("group_id"))


HELD = 1 << 16  # rows that a task holds of all groups before it keeps the first of each


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """``df`` without rows that can't be among the first ``n`` of their group by ``order``: every task keeps ``n`` rows of a group.

    Nothing is shuffled, and no more than HELD rows and those kept are sorted at once; what is left of a group has at most ``n`` rows a
    task. Where groups are so many that what is kept outgrows HELD, it is handed on, and more rows of a group may be left.
    Nulls come first. ``by`` and ``order`` are columns of simple types.
    """

    def first(table: pa.Table) -> pa.Table:
        code = np.zeros(table.num_rows, np.int64)
        for name in by:  # groups as numbers, null being a value
            own = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        sought = pa.table([pa.array(code), *[table.column(c) for c in order]], names=["0", *[str(i + 1) for i in range(len(order))]])
        at = pc.sort_indices(sought, sort_keys=[(c, "ascending") for c in sought.column_names], null_placement="at_start").to_numpy()
        begin = np.flatnonzero(np.diff(code[at], prepend=-1))
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        return table.take(pa.array(at[place < n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        kept = size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            if size - kept >= HELD:
                held = [first(pa.concat_tables(held))]
                kept = size = held[0].num_rows
                if kept >= HELD:
                    yield from held[0].combine_chunks().to_batches()
                    held, kept, size = [], 0, 0
        if held:
            yield from first(pa.concat_tables(held)).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def choose_diverse(df: DataFrame, structure: str, template: str, key: str, target: int, seed: int) -> DataFrame:
    """Round robin over structures, and within each over its templates, smallest first; ``position`` tells the turn.

    A row's turn in its structure follows from its rank in its template and the template's size, so two windows replace
    the queues. What can't be among the first ``target`` rows of a template, and then of a structure, is dropped in its
    task before either window: no more than ``target`` rows a group and task are shuffled or sorted. Null structures and
    templates are values like any other.
    """
    rows = _rows(df, structure=F.col(structure), template=F.col(template), key=F.col(key), rank=F.coalesce(hash_rank(F.col(key), seed), F.lit("")))
    sizes = materialize(rows.groupBy("structure", "template").agg(F.count("*").alias("size")), "sizes")
    rows = first_n(rows, ["structure", "template"], ["rank", "key"], target)
    turn = F.row_number().over(Window.partitionBy("structure", "template").orderBy("rank", "key"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= target)
    own = sizes.select(F.col("structure").alias("s"), F.col("template").alias("t"), "size")
    rows = rows.join(small(own), rows["structure"].eqNullSafe(own["s"]) & rows["template"].eqNullSafe(own["t"])).drop("s", "t")
    rows = first_n(rows, ["structure"], ["turn", "size", "template"], target)
    position = F.row_number().over(Window.partitionBy("structure").orderBy("turn", "size", "template")).cast("long")
    rows = rows.withColumn("position", position).where(F.col("position") <= target)
    whole = sizes.groupBy(F.col("structure").alias("s")).agg(F.sum("size").alias("rows"))
    rows = rows.join(small(whole), rows["structure"].eqNullSafe(whole["s"]))
    return rows.orderBy("position", "rows", "structure").limit(target).select("_row.*", "position")


def mix_replay(enhancement: DataFrame, clean: DataFrame, row_key: Column, stratum: str, key: str, replay: int, seed: int) -> DataFrame:
    """Enhancement rows plus ``replay`` clean rows that are none of them, in a deterministic random order (column ``ord``)."""
    pool = exclude(clean, enhancement, row_key, row_key)
    both = enhancement.withColumn("part", F.lit("enhancement")).unionByName(stratified_floor(pool, stratum, key, replay, seed).withColumn("part", F.lit("replay")))
    return both.withColumn("ord", hash_rank(F.col(key), seed + 1))


def numbered(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """``df`` with its place from 0 in the order of a column, counted within ranges of it plus what the ranges before hold.

    Equal values keep together, in no given order; nulls come first.
    """
    rows = _rows(df, order=F.col(order)).repartitionByRange(F.col("order")).sortWithinPartitions("order").withColumn("id", F.monotonically_increasing_id())
    rows = materialize(rows, "numbered")
    part, at = F.shiftrightunsigned("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumns({"part": part, "at": at})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "part").select("_row.*", (F.col("before") + F.col("at")).alias(name))


def skip_batches(df: DataFrame, order: str, batch: int, skip: int) -> DataFrame:
    """Rows of batches left after resuming: ``batch_no`` from ``skip`` on."""
    n = numbered(df, order, "_number")
    return n.withColumn("batch_no", F.floor(F.col("_number") / batch).cast("long")).where(F.col("batch_no") >= skip).drop("_number")


def shard(df: DataFrame, order: str, shards: int) -> DataFrame:
    """``df`` with ``rank``: rows are dealt to shards in turn, in the order of a column."""
    n = numbered(df, order, "_number")
    return n.withColumn("rank", F.pmod("_number", F.lit(shards)).cast("long")).drop("_number")


def resumed_step(step: Column, before: int, now: int) -> Column:
    """The step at which a run of ``now`` workers goes on that ``before`` workers took to ``step``: as many rows are behind both."""
    if min(before, now) < 1:
        raise ValueError("a run has at least one worker")
    return F.floor(step.cast("decimal(38,0)") * before / now).cast("long")
