"""Factors online: a compiled list over a stream of closed slots, with a state of a few numbers for each instrument and day.

A micro-batch brings rows of slots that have closed. Its rows meet the state that the rows before them
left (the cursor: the last slot seen, and for each running column of every level what its recurrence
carries), all levels are computed over the new rows alone by the same formulas as in a batch run, and
the state that each key's last row leaves is written for the next micro-batch. The work of a batch
grows with its rows and with the keys of the days that are kept, not with the day so far.

State and rows are Parquet folders by number of the micro-batch under `folder`. A batch reads state
n - 1 and overwrites rows n and state n, so one that is run again after a failure gives the same
result; a restart goes on from the stream's checkpoint. The last two states are kept. History columns
are computed once for each date, from the daily grid, and kept by date.

Rows at or before a key's cursor, and rows of days that are no longer kept, are late and left out. Factors
that need the rest of the day (targets) are refused. Ranks are of the rows of a slot that one batch brings:
a slot closes for all instruments at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.operators.recurrence import CURSOR, Recurrence
from tidegrid.plans.factors import Compiled, FactorDef, compiled, ranked_targets

KEY = ["date", "instrument"]


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def recurrences(c: Compiled) -> dict[str, Recurrence]:
    return {n: v for running, _ in c.stages() for stage in running for n, v in stage.items() if isinstance(v, Recurrence)}


def advance(c: Compiled, rows: DataFrame, state: DataFrame | None, history: DataFrame | None, ranks: bool = False, raw: bool = False) -> DataFrame:
    """Factors of new rows, with the state that each leaves. state: date, instrument, CURSOR and what is carried; None where nothing has been seen."""
    known = recurrences(c)
    if state is not None:
        rows = rows.join(state, KEY, "left").where(F.col(CURSOR).isNull() | (F.col("slot") > F.col(CURSOR)))
    else:
        kinds = {n: "boolean" if "broken" in n else "double" for r, v in known.items() for n in v.carried(r)}
        rows = rows.withColumns({CURSOR: F.lit(None).cast("long")} | {n: F.lit(None).cast(kind) for n, kind in kinds.items()})
    frame = rows if history is None else rows.join(history, KEY)
    left: dict[str, F.Column] = {}
    for running, here in c.stages():
        for stage in running:
            frame = frame.withColumns({n: v.resumed(n) if isinstance(v, Recurrence) else v for n, v in stage.items()})
        plain = [d for d in here if d.kind != "rank_targets"]
        if plain:
            frame = frame.withColumns({d.name: c.built[d.name] for d in plain})
        frame = ranked_targets(frame, [d for d in here if d.kind == "rank_targets"])
    for n, v in known.items():
        left |= v.carried(n)
    # What a row leaves replaces what it was given only after all of it has been read.
    frame = frame.withColumns({f"_new{n}": x for n, x in left.items()}).drop(*left)
    frame = frame.withColumnsRenamed({f"_new{n}": n for n in left})
    return c.finished(frame, ranks, raw, keep=list(left))


@dataclass
class Online:
    """A list of factors over a stream of slots (date, instrument, slot and intraday fields).

    daily: the dense daily grid with a row for every day that is streamed; of that day's own row only the
    factor is read. days_kept: calendar days before the latest one whose state is kept.
    """

    defs: Sequence[FactorDef]
    daily: DataFrame
    folder: str
    slots: int
    ranks: bool = False
    raw: bool = False
    days_kept: int = 1

    def _history(self, c: Compiled) -> None:
        """Writes the history columns of dates that are not there yet."""
        spark, path = self.daily.sparkSession, f"{self.folder}/history"
        side = c.history(self.daily)
        if exists(spark, path):
            have = spark.read.parquet(path).select("date").distinct()
            side = side.join(have, "date", "left_anti")
        side.repartition("date").write.mode("append").partitionBy("date").parquet(path)

    def start(self, stream: DataFrame, all_there: bool = True) -> StreamingQuery:
        """all_there: drains what the source holds and ends; otherwise goes on."""
        c = compiled(self.defs, stream.columns, self.slots)
        for r, v in recurrences(c).items():
            v.resumed(r)  # a target is refused here, not in the first batch
        if c.reads_history:
            self._history(c)
        rows = stream.select(*c.KEYS, *c.inputs(stream))

        def step(batch: DataFrame, number: int) -> None:
            self._step(c, batch, number)

        writer = rows.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(step)
        return (writer.trigger(availableNow=True) if all_there else writer).start()

    def _step(self, c: Compiled, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, states = f"{self.folder}/rows/batch={number}", f"{self.folder}/state"
        before = spark.read.parquet(f"{states}/{number - 1}") if number else None
        if before is not None:
            latest = before.agg(F.max("date")).first()[0]
            if latest is not None:
                batch = batch.where(F.col("date") >= F.date_sub(F.lit(latest), self.days_kept))
        history = None
        if c.reads_history:
            dates = [r["date"] for r in batch.select("date").distinct().collect()]  # days of one batch
            history = spark.read.parquet(f"{self.folder}/history").where(F.col("date").isin(dates))
        advance(c, batch, before, history, self.ranks, self.raw).write.mode("overwrite").parquet(rows)
        made = spark.read.parquet(rows)
        carried = [n for r, v in recurrences(c).items() for n in v.carried(r)]
        last = made.groupBy(*KEY).agg(F.max("slot").cast("long").alias(CURSOR), *[F.max_by(n, "slot").alias(n) for n in carried])
        if before is not None:
            last = last.unionByName(before.join(last, KEY, "left_anti"))
        newest = last.agg(F.max("date").alias("_newest"))
        kept = last.join(F.broadcast(newest), how="cross").where(F.col("date") >= F.date_sub("_newest", self.days_kept)).drop("_newest")  # one row beside each
        kept.write.mode("overwrite").parquet(f"{states}/{number}")
        if number > 1:
            remove(spark, f"{states}/{number - 2}")

    def output(self) -> DataFrame:
        """Keys and factors of all slots that have closed."""
        out = self.daily.sparkSession.read.parquet(f"{self.folder}/rows")
        return out.drop("batch", *[c for c in out.columns if c.startswith("_z")])
