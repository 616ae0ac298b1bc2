"""A restartable loop over days: what is finished stands in a manifest that is written after the data.

The manifest is a folder of Parquet files beside the store: a row for each day and run with the number of rows
saved. A day counts as finished only when its row is there, so a run that dies between the data and the
manifest does the day again; saving replaces the day's partition, so doing it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.panel import missing_dates
from tidegrid.plans.online import exists
from tidegrid.sources.store import PanelStore, Variable

MANIFEST = "date date, variable string, rows long, at timestamp"


@dataclass
class DayLoop:
    """build makes the rows of some dates; at_once: dates that one job works on."""

    store: PanelStore
    inputs: Sequence[Variable]
    output: Variable
    build: Callable[[Sequence], DataFrame]
    at_once: int = 20

    @property
    def _path(self) -> str:
        return f"{self.store.root.rstrip('/')}/_manifest"

    def manifest(self) -> DataFrame:
        spark = self.store.spark
        all_ = spark.read.schema(MANIFEST).parquet(self._path) if exists(spark, self._path) else spark.createDataFrame([], MANIFEST)
        return all_.where(F.col("variable") == self.store.path(self.output))

    def todo(self) -> list:
        """Dates that all inputs have and the manifest lacks, in order: as many as trading days."""
        have = self.store.dates(*self.inputs)
        return [r["date"] for r in missing_dates(have, self.manifest()).orderBy("date").collect()]

    def _note(self, dates: Sequence) -> None:
        saved = self.store.load(self.output).where(F.col("date").isin(list(dates)))
        rows = saved.groupBy("date").agg(F.count("*").alias("rows"))
        every = self.store.spark.createDataFrame([(d,) for d in dates], "date date")  # days without a row are finished too
        noted = every.join(rows, "date", "left").select("date", F.lit(self.store.path(self.output)).alias("variable"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.current_timestamp().alias("at"))
        noted.coalesce(1).write.mode("append").parquet(self._path)  # a few rows

    def run(self) -> int:
        """Works off what is to be done; how many dates that was."""
        todo = self.todo()
        for at in range(0, len(todo), self.at_once):
            dates = todo[at : at + self.at_once]
            self.store.save(self.output, self.build(dates), overwrite=True)
            self._note(dates)
        return len(todo)
