"""Output that grows by whole groups: a commit log tells which are there, and a run that starts anew goes on behind them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.curate import small
from quernel.sources.reports import write_json


class GroupLog:
    """Rows by group in ``path``, each group whole and once, whatever runs were cut short.

    A batch is written to a folder of its own, with the groups that it has, and counts once its entry stands in the
    commit log: a numbered file, made by one rename that fails if another run took the number. What has no entry is not
    read. Runs at the same time both go on: who comes second at a number looks at what was committed meanwhile, and
    writes its batch anew without these groups.
    """

    def __init__(self, spark: SparkSession, path: str, group: str):
        self.spark, self.path, self.group = spark, path.rstrip("/"), group

    # --- the log ---

    def entries(self) -> list[dict]:
        """The log's entries in their order: {"batch", "rows", "groups"}."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        names = sorted(f.getPath().getName() for f in system.listStatus(at) if f.getPath().getName().endswith(".json"))
        if not names:
            return []
        found = self.spark.read.text([f"{self.path}/log/{n}" for n in names], wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        return [json.loads(r["value"]) for r in sorted(found.collect(), key=lambda r: r["name"])]  # one row a batch

    def _commit(self, number: int, entry: dict) -> bool:
        try:
            write_json(self.spark, f"{self.path}/log/{number:09d}.json", entry)
        except FileExistsError:
            return False
        except Exception as error:  # another run's rename came first
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _table(self, kind: str, entries: list[dict]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/{e['batch']}" for e in entries]) if entries else None

    def committed(self) -> DataFrame | None:
        """The groups that are there; None before the first."""
        return self._table("groups", self.entries())

    def read(self) -> DataFrame | None:
        """The rows that are there; None before the first."""
        return self._table("rows", self.entries())

    # --- runs ---

    def pending(self, df: DataFrame, entries: list[dict] | None = None) -> DataFrame:
        """Rows of ``df`` whose group is not there yet. A null group is one group."""
        there = self._table("groups", self.entries() if entries is None else entries)
        if there is None:
            return df
        there = there.select(F.col(self.group).alias("_there"))
        return df.join(small(there), df[self.group].eqNullSafe(there["_there"]), "left_anti")

    def append(self, df: DataFrame) -> int:
        """Write the groups of ``df`` that are not there yet, and commit them at once; the number of rows written."""
        while True:
            before = self.entries()
            batch = uuid.uuid4().hex
            self.pending(df, before).write.parquet(f"{self.path}/rows/{batch}")
            rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/rows/{batch}")
            rows.groupBy(self.group).agg(F.count("*").alias("rows")).write.parquet(f"{self.path}/groups/{batch}")
            seen = self.spark.read.parquet(f"{self.path}/groups/{batch}").agg(F.count("*").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
            if not seen["rows"]:
                return 0
            own = self.spark.read.parquet(f"{self.path}/groups/{batch}")
            number = len(before)
            while not self._commit(number, {"batch": batch, "rows": seen["rows"], "groups": seen["groups"]}):
                meanwhile = self.entries()[number:]
                if self.pending(own, meanwhile).count() < seen["groups"]:
                    break  # some of these groups came from another run
                number += len(meanwhile)
            else:
                return seen["rows"]

    def run(self, source: DataFrame, make: Callable[[DataFrame], DataFrame], batches: int) -> int:
        """Groups of ``source`` that are not there yet through ``make``, in so many batches, each committed when it is whole.

        Which batch a group is in follows from its hash alone. The number of rows written; run again what was cut short.
        """
        place = F.pmod(F.xxhash64(self.group), F.lit(batches))
        return sum(self.append(make(self.pending(source.where(place == b)))) for b in range(batches))
