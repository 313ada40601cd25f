"""Roll-ups of metrics records."""

from __future__ import annotations

import sys
import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module


def _number(c: Column, kind: T.DataType) -> Column:
    return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else c.cast("double")


def aggregate(df: DataFrame, metrics: str = "metrics", by: list[str] | None = None, overall: bool = True, only: list[str] | None = None) -> DataFrame:
    """Long form: group columns, level ('overall' or 'group'), metric, mean, n.

    Means skip null (not applicable) values and n counts the others; booleans count as 0 and 1. ``*_micro`` metrics are
    sums of hits over sums of counts, null without counts; ``samples`` has the number of rows as n. One aggregation
    over grouping sets; a null group is told from the overall level by the grouping id. ``only`` names the metrics that
    are wanted: no other is computed, nor becomes a row of each group to be dropped again.
    """
    by = by or []
    numeric = [f for f in df.schema[metrics].dataType.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    wanted = lambda name: only is None or name in only
    fields = [f for f in numeric if wanted(f.name)]
    aggs = [F.count(F.lit(1)).alias("samples")]
    for f in fields:
        value = _number(F.col(metrics)[f.name], f.dataType)
        aggs += [F.avg(value).alias(f"mean_{f.name}"), F.count(value).alias(f"n_{f.name}")]
    names = {f.name for f in numeric}
    micro = [p for p in ("", "key_") if f"{p}attribute_count" in names and wanted(f"{p}literal_coverage_micro")]
    for p in micro:
        total = F.sum(F.col(metrics)[f"{p}attribute_count"])
        aggs.append(F.when(total > 0, F.sum(F.col(metrics)[f"{p}attribute_hits"]) / total).alias(f"micro_{p}"))
    if by:
        sets = ([[]] if overall else []) + [[F.col(c) for c in by]]
        wide = df.groupingSets(sets, *by).agg(F.grouping_id(*by).alias("gid"), *aggs)
    else:
        wide = df.agg(F.lit(1).alias("gid"), *aggs)
    rows = [F.struct(F.lit("samples").alias("metric"), F.lit(None).cast("double").alias("mean"), F.col("samples").alias("n"))] if wanted("samples") else []
    rows += [F.struct(F.lit(f.name).alias("metric"), F.col(f"mean_{f.name}").alias("mean"), F.col(f"n_{f.name}").alias("n")) for f in fields]
    rows += [F.struct(F.lit(f"{p}literal_coverage_micro").alias("metric"), F.col(f"micro_{p}").alias("mean"), F.col("samples").alias("n")) for p in micro]
    level = F.when(F.col("gid") == 0, "group").otherwise("overall")
    return wide.select(*by, level.alias("level"), F.explode(F.array(*rows)).alias("r")).select(*by, "level", "r.*")


def format_metric(value: float | None, percentage: bool) -> str:
    """A metric for people to read."""
    if value is None:
        return "not applicable"
    return f"{value * 100:.2f}%" if percentage else f"{value:.2f}"


def best_so_far(loss: str, order: str, series: str) -> Column:
    """Running minimum of a loss over the rows of its series up to this one."""
    return F.min(loss).over(Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


# --- sums that don't depend on the order ----------------------------------------------------------------------------

LIMB = 32  # bits
_LOWEST = 1126  # a double is a whole number of 53 bits times 2^e with e >= -_LOWEST


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("limb", "low", "middle", "high")]))
def limbs(values: pd.Series) -> pd.DataFrame:
    """A finite double as low + middle * 2^32 + high * 2^64, all under 2^34, times 2^(32 * limb - _LOWEST)."""
    fraction, exponent = np.frexp(values.to_numpy(float))
    whole = (fraction * 2.0**53).astype(np.int64)
    limb, shift = np.divmod(exponent.astype(np.int64) - 53 + _LOWEST, LIMB)
    low = (whole & 0xFFFFFFFF) << shift
    high = (whole >> LIMB) << shift
    return pd.DataFrame({"limb": limb, "low": low & 0xFFFFFFFF, "middle": (low >> LIMB) + (high & 0xFFFFFFFF), "high": high >> LIMB})


@F.pandas_udf(T.DoubleType())
def _rounded(parts: pd.Series) -> pd.Series:
    """The double nearest to the sum of some limbs."""

    def one(own) -> float:
        total = sum((int(p["low"]) + (int(p["middle"]) << LIMB) + (int(p["high"]) << 2 * LIMB)) << (LIMB * int(p["limb"])) for p in own)
        try:
            return total / (1 << _LOWEST)  # of whole numbers: rounded once
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return parts.map(one)


def exact_sums(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, total, n): the exact sum of a double, rounded once, and how many values it has; the same bits however rows lie.

    Doubles are added up as whole numbers in limbs, combined before the shuffle; a group has some 70 limbs at most.
    Nulls are skipped (total is null without values); infinities and NaN give what they add up to.
    """
    x = F.col(value).cast("double")
    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], x.alias("x"), sound.alias("sound"))
    keys = [f"_{i}" for i in range(len(by))]
    told = rows.withColumn("part", limbs(F.when(F.col("sound"), F.col("x")).otherwise(F.lit(0.0))))
    total = lambda c: F.sum(F.col(f"part.{c}").cast("decimal(38,0)")).alias(c)
    summed = told.groupBy(*keys, "part.limb").agg(total("low"), total("middle"), total("high"), F.count("x").alias("n"), F.sum(F.when(~F.col("sound"), F.col("x"))).alias("odd"))
    whole = summed.groupBy(*keys).agg(F.collect_list(F.struct("limb", "low", "middle", "high")).alias("parts"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    exact = F.coalesce("odd", F.when(F.col("n") > 0, _rounded("parts")))
    return whole.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], exact.alias("total"), "n")


def validation_loss(df: DataFrame, loss: str, batch: str, rank: str) -> tuple[DataFrame, DataFrame]:
    """(rank, total, n) and one row (loss, batches): the mean of batch means, every batch of every rank counting once.

    A rank adds up the means of its batches, and the ranks' sums and numbers are added up in turn, as workers do that
    reduce their losses; sums are exact, so that the result has the same bits for any number of partitions. Batches
    without a loss don't count.
    """
    means = exact_sums(df, loss, [rank, batch]).where("n > 0").select(F.col(rank), (F.col("total") / F.col("n")).alias("mean"))
    own = exact_sums(means, "mean", [rank])
    both = exact_sums(own, "total", []).select("total").join(own.agg(F.sum("n").alias("batches")))
    return own, both.select((F.col("total") / F.col("batches")).alias("loss"), "batches")
