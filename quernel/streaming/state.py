"""Summaries of logs as streams with state: a batch costs what it brings, and every step has a snapshot."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quernel.operators.logs import decoded, judged, losses

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PART = "n long, total double, low double, high double, head array<double>, tail array<double>"
_SHOWN = "log string, step long, n long, head_mean double, tail_mean double, min_loss double, max_loss double, mean_loss double"


class Part:
    """What is kept of losses in their order: number, sum, least, greatest, the first and last ``most``."""

    def __init__(self, most: int, kept: tuple | None = None):
        self.most = most
        self.n, self.total, self.low, self.high, head, tail = kept or (0, 0.0, None, None, [], [])
        self.head, self.tail = list(head), list(tail)

    def append(self, n: int, total: float, low: float, high: float, head: list[float], tail: list[float]) -> None:
        """Put what is kept of later losses behind."""
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)
        self.n, self.total = self.n + n, self.total + total
        if len(self.head) < self.most:  # then head has all there is
            self.head = (self.head + head)[: self.most]
        self.tail = (self.tail + tail)[-self.most :]

    def add(self, values: list[float]) -> None:
        self.append(len(values), sum(values), min(values), max(values), values[: self.most], values[-self.most :])

    def kept(self) -> tuple:
        return self.n, self.total, self.low, self.high, self.head, self.tail


def _partial(most: int):
    """Frames of (log, file, place, loss) in their order to one row a piece of a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, Part] = {}
        for frame in frames:
            for key, own in frame.groupby(["log", "file", "place"], sort=False, dropna=False)["loss"]:
                parts.setdefault(key, Part(most)).add(own.tolist())
        if parts:
            yield pd.DataFrame([(*key, *part.kept()) for key, part in parts.items()], columns=["log", "file", "place", *(f.split()[0] for f in _PART.split(", "))])

    return run


class LogState(StatefulProcessor):
    """Merges the pieces that a batch brings into what is kept of a log, and shows it."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("summary", f"step long, {_PART}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, *kept = self.state.get() if self.state.exists() else (0,)
        own = Part(self.most, tuple(kept) or None)
        for r in pd.concat(list(rows)).sort_values(["file", "place"]).itertuples():
            own.append(int(r.n), float(r.total), float(r.low), float(r.high), list(r.head), list(r.tail))
        step = int(step) + 1
        self.state.update((step, *own.kept()))
        mean = lambda x: sum(x) / len(x)
        yield pd.DataFrame({"log": [key[0]], "step": [step], "n": [own.n], "head_mean": [mean(own.head)], "tail_mean": [mean(own.tail)], "min_loss": [own.low], "max_loss": [own.high], "mean_loss": [own.total / own.n]})

    def close(self) -> None:
        pass


def log_snapshots(spark: SparkSession, folder: str, log: Column | None = None, most: int = 20, files: int | None = None) -> DataFrame:
    """A stream of (log, step, n, head_mean, tail_mean, min_loss, max_loss, mean_loss, delta, trend, below_baseline).

    One row a log and batch that brought it losses: the summary of all its losses so far; ``step`` counts these rows. A
    log is a file, or what ``log`` makes of ``_metadata.file_path``; its lines are in the order of batches, then of
    files by name, then of places. Files may be read in pieces by many tasks; each hands on one row a piece. The state
    of a log is a row of 2 * ``most`` losses in the checkpoint, so that a query that starts anew, with whatever number
    of workers, goes on where it was. ``files`` of a folder make a batch, at most.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    path = F.col("_metadata.file_path")
    lines = reader.text(folder).select("value", (path if log is None else log).alias("log"), path.alias("file"), F.col("_metadata.file_block_start").alias("place"))
    placed = decoded(lines).select("value", F.struct("log", "file", "place").alias("line_number"))
    found = losses(placed).select("line_number.log", "line_number.file", "line_number.place", "loss").where("loss is not null")
    parts = found.mapInPandas(_partial(most), f"log string, file string, place long, {_PART}")
    shown = parts.groupBy("log").transformWithStateInPandas(statefulProcessor=LogState(most), outputStructType=_SHOWN, outputMode="Append", timeMode="None")
    return judged(shown)


def keep_snapshots(snapshots: DataFrame, out: str, checkpoint: str):
    """Append the snapshots to Parquet files in ``out``, each once, until all that there is has been read."""
    return snapshots.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def at_step(spark: SparkSession, out: str, step: int | None = None) -> DataFrame:
    """Of every log the last snapshot up to ``step``, or the last of all."""
    rows = spark.read.parquet(out)
    rows = rows if step is None else rows.where(F.col("step") <= step)
    names = [c for c in rows.columns if c != "log"]
    return rows.groupBy("log").agg(F.max_by(F.struct(*names), "step").alias("r")).select("log", "r.*")
