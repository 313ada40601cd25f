"""Training-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The loss of an untrained pairwise model, and the change that counts as a trend.
BASELINE, TREND = 0.693147, 0.005


def decoded(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a log in which bytes that are no UTF-8 are replaced by U+FFFD."""
    return lines.withColumn(line, F.make_valid_utf8(line))


def losses(lines: DataFrame, line: str = "value", order: str = "line_number") -> DataFrame:
    """(order, pos, loss): every ``loss:<number>`` of every line in turn."""
    # Fixed value: how a loss is written in a log.
    found = F.regexp_extract_all(F.col(line), F.lit(r"loss:([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return lines.select(order, F.posexplode(found).alias("pos", "loss")).withColumn("loss", F.col("loss").cast("double"))


def summarize(found: DataFrame, order: str = "line_number", n: int = 20) -> DataFrame:
    """One row: count, mean of the first and last ``n``, their difference and its trend, min, max, mean.

    Head and tail are two top-n selections, so that no window spans the log.
    """
    head = found.orderBy(order, "pos").limit(n).agg(F.avg("loss").alias("head_mean"))
    tail = found.orderBy(F.desc(order), F.desc("pos")).limit(n).agg(F.avg("loss").alias("tail_mean"))
    whole = found.agg(F.count("*").alias("n"), F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), F.avg("loss").alias("mean_loss"))
    return judged(whole.join(F.broadcast(head)).join(F.broadcast(tail)))


def judged(summary: DataFrame) -> DataFrame:
    """``summary`` with the difference of its tail's and head's means, what trend that is, and whether the tail is under the baseline."""
    out = summary.withColumn("delta", F.col("tail_mean") - F.col("head_mean"))
    trend = F.when(F.col("delta") < -TREND, "falling").when(F.col("delta") > TREND, "rising").otherwise("flat")
    return out.withColumns({"trend": trend, "below_baseline": F.col("tail_mean") < BASELINE})
