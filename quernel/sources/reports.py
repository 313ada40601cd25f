"""Reports and manifests: small JSON files on whatever store Spark reaches."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from quernel.operators.metrics import format_metric

STATES = ("prepared", "loading", "running", "complete")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict, overwrite: bool = False) -> None:
    """Write one JSON document; an existing file is refused unless ``overwrite``. A replaced file is never seen half written."""
    fs, target = _at(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    _, part = _at(spark, path + ".part")
    out = fs.create(part, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode("utf-8")))
    finally:
        out.close()
    # one step that replaces the target, so that a reader always finds a whole file
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if overwrite else option.NONE
    files.rename(part, target, options)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def run_name(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S%fZ")


class Manifest:
    """Provenance of a run: a JSON file whose status only moves forward."""

    def __init__(self, spark: SparkSession, path: str, **facts):
        self.spark, self.path, self.value = spark, path, {"status": STATES[0]} | facts
        write_json(spark, path, self.value)

    def advance(self, status: str, **facts) -> None:
        if STATES.index(status) < STATES.index(self.value["status"]):
            raise ValueError(f"a manifest does not go from {self.value['status']} back to {status}")
        self.value |= {"status": status} | facts
        write_json(self.spark, self.path, self.value, overwrite=True)


def nested(rollup: DataFrame, group: str | None = None) -> dict:
    """A roll-up (level, metric, mean, n) as {overall: {metric: {mean, n}}, by_<group>: {value: ...}}; micro ratios are bare."""
    out: dict = {"overall": {}}
    for r in rollup.collect():
        value = r["n"] if r["metric"] == "samples" else r["mean"] if r["metric"].endswith("_micro") else {"mean": r["mean"], "n": r["n"]}
        place = out["overall"] if r["level"] == "overall" else out.setdefault(f"by_{group}", {}).setdefault(r[group], {})
        place[r["metric"]] = value
    return out


def table(columns: dict[str, dict], percentages: tuple[str, ...] = ()) -> str:
    """Metrics of several groups side by side, one line a metric."""
    names = list(dict.fromkeys(k for c in columns.values() for k in c))

    def cell(value, name):
        if isinstance(value, dict):
            return f"{format_metric(value.get('mean'), name in percentages)} (n={value.get('n', '?')})"
        return format_metric(value, name in percentages)

    return "\n".join([" | ".join(["metric", *columns])] + [" | ".join([n, *(cell(c.get(n), n) for c in columns.values())]) for n in names])
