"""Comparison and integrity of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_maps(left: DataFrame, right: DataFrame, on: str, differing: bool = False) -> DataFrame:
    """Full outer join of two (on, key, value) tables: status is unknown where a side is missing or null, else same or different.

    ``differing`` keeps only keys whose values are not the same on both sides, a missing value being one of its own.
    """
    l, r = left.select(on, "key", F.col("value").alias("left_value")), right.select(on, "key", F.col("value").alias("right_value"))
    status = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "unknown").when(F.col("left_value") == F.col("right_value"), "same").otherwise("different")
    out = l.join(r, [on, "key"], "full_outer").withColumn("status", status)
    return out.where(~F.col("left_value").eqNullSafe(F.col("right_value"))) if differing else out


def pair_runs(left: DataFrame, right: DataFrame, key: str, checked: list[str], limit: int = 0, strict: bool = True) -> DataFrame:
    """Rows of both runs by ``key`` (left_*, right_*), the first ``limit`` in order (0: all).

    ``mismatch`` tells whether any of ``checked`` differs; strict comparisons fail on the first that does.
    """
    l = left.select(key, *[F.col(c).alias(f"left_{c}") for c in left.columns if c != key])
    r = right.select(key, *[F.col(c).alias(f"right_{c}") for c in right.columns if c != key])
    joined = l.join(r, key)
    joined = joined.orderBy(key).limit(limit) if limit else joined
    differ = F.lit(False)
    for c in checked:
        differ = differ | ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}"))
    if strict:
        differ = F.when(differ, F.raise_error(F.concat(F.lit("inputs differ at "), F.col(key).cast("string")))).otherwise(F.lit(False))
    return joined.withColumn("mismatch", differ)


def integrity(df: DataFrame, key: str, output: str, declared: int | None = None) -> DataFrame:
    """One row: rows, distinct_keys, with_output, unique, complete (all rows or none have an output), as_declared."""
    a = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"), F.count(output).alias("with_output"))
    return a.withColumns({
        "unique": F.col("rows") == F.col("distinct_keys"),
        "complete": F.col("with_output").isin(0) | (F.col("with_output") == F.col("rows")),
        "as_declared": F.lit(True) if declared is None else F.col("rows") == declared,
    })


def side_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left_only, right_only, both, the numbers of distinct keys; null is a key like any other."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda l, r: F.count_if((F.col("l") == l) & (F.col("r") == r))
    return seen.agg(count(1, 0).alias("left_only"), count(0, 1).alias("right_only"), count(1, 1).alias("both"))


def key_changes(left: Column, right: Column) -> Column:
    """Of two maps struct<either, both, left_only, right_only>: sorted names of keys; a null map has none."""
    none = F.array().cast("array<string>")
    l, r = F.coalesce(F.map_keys(left), none), F.coalesce(F.map_keys(right), none)
    parts = {"either": F.array_union(l, r), "both": F.array_intersect(l, r), "left_only": F.array_except(l, r), "right_only": F.array_except(r, l)}
    return F.struct(*[F.array_sort(c).alias(n) for n, c in parts.items()])


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def audit_pairs(df: DataFrame, group: list[str], style: str, attributes: str) -> DataFrame:
    """Per group of twins: n_structured, n_natural, outcome (ambiguous, paired, mismatch, unpaired)."""
    own = lambda s: F.when(F.col(style) == s, F.col(attributes))
    g = df.groupBy(*group).agg(
        F.count_if(F.col(style) == "structured").alias("n_structured"),
        F.count_if(F.col(style) == "natural").alias("n_natural"),
        F.first(own("structured"), ignorenulls=True).alias("_s"),
        F.first(own("natural"), ignorenulls=True).alias("_n"),
    )
    outcome = (
        F.when((F.col("n_structured") > 1) | (F.col("n_natural") > 1), "ambiguous")
        .when((F.col("n_structured") == 0) | (F.col("n_natural") == 0), "unpaired")
        .when(same_set(F.col("_s"), F.col("_n")), "paired")
        .otherwise("mismatch")
    )
    return g.withColumn("outcome", outcome).drop("_s", "_n")


#: Marks that are counted inside structured values.
MARKS = ("、", "，", ",", "；", ";", "/")


def value_marks(values: DataFrame, value: str, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """(mark, n): in how many values each mark occurs; every row is a value, repeated ones count each."""
    found = F.filter(F.array(*map(F.lit, marks)), lambda c: F.col(value).contains(c))
    return values.select(F.explode(found).alias("mark")).groupBy("mark").agg(F.count("*").alias("n"))


def audit_report(df: DataFrame, group: list[str], style: str, attributes: str, prompt: str, line: str, first: int = 1000) -> dict:
    """Counts of an audit of twins, and the lines of the first ``first`` groups that are ambiguous or do not match."""
    groups = audit_pairs(df, group, style, attributes)
    outcomes = {r["outcome"]: r["count"] for r in groups.groupBy("outcome").count().collect()}
    bad = groups.where(F.col("outcome").isin("ambiguous", "mismatch")).select(*group, "outcome")
    lines = df.join(bad, group).groupBy(*group, "outcome").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    told = {o: [r["lines"] for r in lines.where(F.col("outcome") == o).orderBy(F.col("lines")[0]).limit(first).collect()] for o in ("ambiguous", "mismatch")}
    own = df.where(F.col(style) == "structured").select(F.explode(attributes).alias("a")).select(F.col("a.value").alias("value"))
    many = df.where((F.col(style) == "natural") & F.col(prompt).contains("、")).count()
    return {
        "rows": df.count(),
        "paired_groups": outcomes.get("paired", 0) + outcomes.get("mismatch", 0),
        "unpaired_groups": outcomes.get("unpaired", 0),
        "natural_multivalue_rows": many,
        "structured_value_marks": {r["mark"]: r["n"] for r in value_marks(own, "value").collect()},
        "mismatches": told["mismatch"],
        "ambiguous_groups": told["ambiguous"],
    }
