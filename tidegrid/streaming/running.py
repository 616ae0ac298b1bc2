"""Streaming: bars and running-day statistics over an event stream.

Running factors depend on their day's past alone through a handful of sums, so they are ordinary
streaming aggregates with O(1) state for each key; a watermark lets the state of finished days go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators import moments
from tidegrid.operators.xsection import TAIL_EDGES
from tidegrid.plans import evaluate


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, late: str = "1 hour") -> DataFrame:
    """events as a file stream with a watermark on ts."""
    path = f"{folder.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def hourly(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """instrument, start, volume, amount, high, low of tumbling windows."""
    return stream.groupBy(F.window("ts", width), F.col("user_id").alias("instrument")).agg(
        F.count("*").alias("volume"), F.sum("value").alias("amount"), F.max("value").alias("high"), F.min("value").alias("low")
    ).select("instrument", F.col("window.start").alias("start"), "volume", "amount", "high", "low")


def running_day(stream: DataFrame) -> DataFrame:
    """The day's statistics so far of each instrument: count, sum, extremes, standard deviation and adjusted skewness from raw sums."""
    x = F.col("value")
    sums = stream.groupBy(F.window("ts", "1 day"), F.col("user_id").alias("instrument")).agg(
        F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.max(x).alias("high"), F.min(x).alias("low")
    )
    n = F.col("n").cast("double")
    var = F.col("s2") / n - F.pow(F.col("s1") / n, F.lit(2.0))
    return sums.select(
        F.to_date("window.start").alias("date"), "instrument", "n", F.col("s1").alias("total"), "high", "low",
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), moments.adjusted_skewness(n, F.col("s1"), F.col("s2"), F.col("s3")).alias("skewness"),
    )


_STATE = "n long, total double, high double, low double"


def running_state(stream: DataFrame) -> DataFrame:
    """The same sums kept by a custom stateful operator, for statistics that no built-in aggregate expresses: last state of each key.

    A day's state goes once the watermark has passed its end.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, high, low = state.get if state.exists else (0, 0.0, float("-inf"), float("inf"))
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
            high, low = max(high, float(p["value"].max())), min(low, float(p["value"].min()))
        end = int((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if end > state.getCurrentWatermarkMs():
            state.update((n, total, high, low))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"date": [key[0]], "instrument": [key[1]], "n": [n], "total": [total], "high": [high], "low": [low]})

    keyed = stream.select(F.to_date("ts").alias("date"), F.col("user_id").alias("instrument"), "value", "ts")
    return keyed.groupBy("date", "instrument").applyInPandasWithState(update, f"date date, instrument long, {_STATE}", _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def decayed(stream: DataFrame, x: str, decay: float, by: tuple[str, ...], time: str = "date") -> DataFrame:
    """by, time, ewma: s_n = decay s_(n-1) + (1 - decay) x_n from s_0 = x_0, one number of state a key.

    Rows of a batch are taken in order of time; what comes at or before the last time of its key is left out.
    """
    kinds = dict(stream.dtypes)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value = state.get if state.exists else (None, None)
        for row in pd.concat(list(parts)).sort_values(time).itertuples(index=False):
            at, now = getattr(row, time), getattr(row, x)
            if last is None or at > last:
                last, value = at, now if value is None else decay * value + (1 - decay) * now
        state.update((last, value))
        yield pd.DataFrame({**{c: [k] for c, k in zip(by, key, strict=True)}, time: [last], "ewma": [value]})

    out = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{time} {kinds[time]}", "ewma double"])
    rows = stream.select(*by, time, F.col(x).cast("double").alias(x))
    return rows.groupBy(*by).applyInPandasWithState(update, out, f"{time} {kinds[time]}, ewma double", "update", GroupStateTimeout.NoTimeout)


def day_sketches(stream: DataFrame, x: str = "value", k: int = 800) -> DataFrame:
    """date, horizon, sketch: a mergeable sketch of each day's values so far; a new day begins with an empty one."""
    day = stream.groupBy(F.window("ts", "1 day")).agg(F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(k)).alias("sketch"))
    return day.select(F.to_date("window.start").alias("date"), F.lit(x).alias("horizon"), "sketch")


def bracketed_counts(stream: DataFrame, bounds: DataFrame, x: str = "value") -> DataFrame:
    """date, horizon, value, inside, n: each day's streamed values inside its brackets by value, those outside counted beside a bound.

    bounds: date, horizon and _bounds, a row a day. The state of a day is as large as the values its brackets hold.
    """
    days = bounds.where(F.col("horizon") == x).select(F.col("date").alias("_day"), "_bounds")
    inside, value = evaluate.bracketed(x)
    rows = stream.where(F.col(x).isNotNull()).withColumn("_day", F.to_date("ts")).join(days, "_day").withColumns({"inside": inside, "_v": value})
    sums = rows.groupBy(F.window("ts", "1 day"), "_v", "inside").agg(F.count("*").alias("n"))
    return sums.select(F.to_date("window.start").alias("date"), F.lit(x).alias("horizon"), F.col("_v").alias("value"), "inside", "n")


def exact_quantiles(source: Callable[[], DataFrame], sketches: DataFrame, levels: Sequence[float], folder: str, x: str = "value", margin: float = 0.02) -> DataFrame:
    """date, horizon and q, the exact quantiles of each day: the day's sketch says between which values they lie, a second stream counts those.

    Days whose sketch is further off than the margin are streamed again with every value counted.
    """
    keys = ("date", "horizon")

    def settled(sketched: DataFrame, wide: float, name: str) -> DataFrame:
        counts = run_to_table(bracketed_counts(source(), evaluate.brackets(sketched, levels, wide), x), folder, name, "update", (*keys, "value", "inside"))
        out = f"{folder}/{name}-quantiles"
        evaluate.counted_quantiles(counts, keys, levels).write.parquet(out)
        return sketched.sparkSession.read.parquet(out)

    got = settled(sketches, margin, "counts")
    if got.where("_settled").count() == got.count():
        return got.drop("_settled")
    rest = sketches.join(got.where("NOT _settled").select(*keys), list(keys), "left_semi")
    return got.where("_settled").union(settled(rest, 1.0, "all-counts")).drop("_settled")


def quantile_bins(stream: DataFrame, sketches: DataFrame, x: str = "value") -> DataFrame:
    """date, horizon, bin, n, total: the streamed values of each day by their percentile in the day before's sketch.

    sketches: date, horizon, sketch (a row a day). The bins are additive state; a new day begins with none, and the
    watermark lets finished days go. Values of days without a day before them have no percentile and are left out.
    """
    # A value's percentile reaches a level where the value reaches the sketch's quantile there: a day's edges are worked out once.
    edges = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for p in (*[i / 100 for i in range(1, 100)], *TAIL_EDGES)])
    before = sketches.where(F.col("horizon") == x).select(F.date_add("date", 1).alias("_day"), edges.alias("_edges"))
    rows = stream.where(F.col(x).isNotNull()).withColumn("_day", F.to_date("ts"))
    placed = rows.join(before, "_day").withColumn("bin", F.size(F.filter("_edges", lambda e: F.col(x) >= e)))
    sums = placed.groupBy(F.window("ts", "1 day"), "bin").agg(F.count("*").alias("n"), F.sum(x).alias("total"))
    return sums.select(F.to_date("window.start").alias("date"), F.lit(x).alias("horizon"), "bin", "n", "total")


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in the order in which they were written; None: all that are there at once."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def closed_slots(events: DataFrame, width: str = "1 hour", day: str = "date") -> DataFrame:
    """date, instrument, slot, mid_price, high, low, volume, amount of slots that the watermark has passed: a row is given once and is final."""
    px = F.col("value") + 100
    bars = events.groupBy(F.window("ts", width), F.col("user_id").alias("instrument")).agg(
        F.max_by(px, F.struct("ts", "event_id")).alias("mid_price"), F.max(px).alias("high"), F.min(px).alias("low"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount")
    )
    return bars.select(F.to_date("window.start").alias(day), "instrument", F.hour("window.start").alias("slot"), "mid_price", "high", "low", "volume", "amount")


def run_to_table(stream: DataFrame, folder: str, name: str, mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Drains a stream into Parquet under `folder` and returns what it holds: the last state of each key where mode is update."""
    path, spark = f"{folder}/{name}", stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    out = spark.read.parquet(path)
    if mode == "complete":
        return out.drop("_batch")
    if mode == "append":
        return out.drop("_batch")
    rest = [c for c in out.columns if c not in (*keys, "_batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")
