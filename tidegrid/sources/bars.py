"""Panels derived from event and order tables: daily bars, hourly bars, monthly bars, predictions.

Bars are partial aggregates before their shuffle; open and close are the values at the first and
last (time, id), so ties are settled the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import ln, ratio
from tidegrid.operators.panel import by_size, densify
from tidegrid.operators.spans import AT, KEYS, TO, Spans


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return e.select("event_id", "ts", F.to_date("ts").alias("date"), F.col("user_id").alias("instrument"), "event_type", "value", (F.col("value") + 100).alias("px"))


def _moment() -> Column:
    return F.struct("ts", "event_id")


def daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """date, instrument, open, high, low, close, volume, amount, factor, daily_return, alpha (missing ones take the return)."""
    bars = events(spark, folder).groupBy("date", "instrument").agg(
        F.min_by("px", _moment()).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", _moment()).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
    )
    split = (F.col("instrument") % 3 == 0) & (F.col("date") >= F.lit("2024-01-16").cast("date"))
    by_time = Window.partitionBy("instrument").orderBy("date")
    back = bars.select(
        "*",
        F.when(split, 2.0).otherwise(1.0).alias("factor"),
        F.coalesce(ln(ratio("close", F.lag("close").over(by_time))), F.lit(0.0)).alias("daily_return"),
    )
    market = F.avg("daily_return").over(Window.partitionBy("date"))
    own = F.when(F.col("instrument") % 7 != 0, F.col("daily_return") - market)
    return back.select("*", own.alias("alpha")).withColumn("alpha", F.coalesce("alpha", "daily_return"))


def dense_daily(daily: DataFrame) -> DataFrame:
    """The daily panel on the calendar of all its dates, filled by the columns' policies, dealt by instrument as bars are that meet it."""
    return densify(daily, time="date", parts=by_size(daily))


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    kind = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0))
    seen = lambda k: F.sum(F.when(F.col("event_type") == k, 1.0).otherwise(0.0))
    return (
        events(spark, folder)
        .groupBy("date", F.hour("ts").alias("slot"), "instrument")
        .agg(
            F.max_by("px", _moment()).alias("mid_price"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.count("*").cast("double").alias("volume"),
            F.sum("value").alias("amount"),
            kind("purchase").alias("buy_amount"),
            kind("click").alias("sell_amount"),
            seen("view").alias("bid_volume1"),
            seen("error").alias("ask_volume1"),
        )
        .withColumn("bid_price1", F.when(F.col("bid_volume1") > 0, F.col("mid_price") * 0.9995).otherwise(0.0))
        .withColumn("ask_price1", F.when(F.col("ask_volume1") > 0, F.col("mid_price") * 1.0005).otherwise(0.0))
    )


ZERO_HOURLY = ("volume", "amount", "buy_amount", "sell_amount", "bid_volume1", "ask_volume1")
SLOTS = 24


def _spans(bars: DataFrame, slots: int) -> Spans:
    """The slot bars as spans over all slots of every day that an instrument has a bar on, with the columns that follow from them.

    Days without a bar have no valid price and would fall to the validity rule, so they are not built. A bar is
    laid out over the slots it stands for: its own and those up to the next bar, the first one those before it too. So the
    windows that fill gaps run over the bars there are, not over the grid.
    """
    fields = [c for c in bars.columns if c not in KEYS]
    prices = [c for c in fields if c not in ZERO_HOURLY]
    day = Window.partitionBy("instrument", "date").orderBy("slot")
    rest = day.rowsBetween(0, Window.unboundedFollowing)  # of one day's bars; a missing price takes the next one there is
    first = F.when(F.lag("slot").over(day).isNull(), 0).otherwise(F.col("slot"))

    def over(dealt: DataFrame) -> DataFrame:
        spans = dealt.select(
            "date", "instrument", first.alias("slot"), F.col("slot").alias(AT), (F.coalesce(F.lead("slot").over(day), F.lit(slots)) - 1).alias(TO),
            *[F.first(c, ignorenulls=True).over(rest).alias(c) if c in prices else F.col(c) for c in fields],
        )
        out = spans.select("date", "instrument", "slot", AT, TO, *[F.when(F.col(AT).isNotNull(), F.col(c)).alias(c) if c in prices else F.col(c) for c in fields])
        return out.withColumn("total_volume", F.col("volume")).withColumn("resid", ln(F.col("mid_price") / 100)).withColumn("resid_rank", F.col("mid_price") / (F.col("mid_price") + 100))

    # One exchange, of the bars there are, serves the grid and everything by instrument and day that follows. It
    # has a fixed number of partitions. Bars that meet the history of their days are dealt as that is.
    parts = by_size(bars)
    out = over(bars.repartition(parts, "date", "instrument"))
    return Spans(out, tuple(c for c in (*ZERO_HOURLY, "total_volume") if c in out.columns), over(bars.repartition(parts, "instrument")))


def _gridded(bars: DataFrame, slots: int) -> DataFrame:
    """The slot bars on all slots of every day that an instrument has a bar on, with the columns that follow from them."""
    return _spans(bars, slots).grid()


def intraday_spans(spark: SparkSession, folder: str) -> Spans:
    """The intraday panel as the hourly bars that it is filled from."""
    return _spans(hourly_bars(spark, folder), SLOTS)


def intraday_panel(spark: SparkSession, folder: str) -> DataFrame:
    """date, slot, instrument and the hourly fields on 24 slots of every day that an instrument has a bar on."""
    return _gridded(hourly_bars(spark, folder), SLOTS)


#: Slots of a half month.
LONG_SLOTS = 4


def _half_months(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem by half months as days (over 160 of them), four slots each, and suppliers as instruments."""
    day = F.dayofmonth("l_shipdate")
    start = F.to_date(F.trunc(F.to_date("l_shipdate"), "month"))
    return read(spark, folder, "lineitem").select(
        F.when(day > 15, F.date_add(start, 15)).otherwise(start).alias("date"), F.col("l_suppkey").alias("instrument"), F.floor(((day - 1) % 15) / 4).cast("int").alias("slot"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", (F.col("l_discount") - F.col("l_tax")).alias("net"),
    )


def long_daily_panel(spark: SparkSession, folder: str) -> DataFrame:
    """A panel long enough for the longest windows: the columns of the daily panel but the open."""
    bars = _half_months(spark, folder).groupBy("date", "instrument").agg(
        F.avg("px").alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").cast("double").alias("volume"), F.sum("l_extendedprice").cast("double").alias("amount"), F.avg("net").alias("alpha")
    )
    split = (F.col("instrument") % 3 == 0) & (F.col("date") >= F.lit("1995-01-01").cast("date"))
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("date"))
    return bars.select("*", F.when(split, 2.0).otherwise(1.0).alias("factor"), F.coalesce(ln(ratio("close", before)), F.lit(0.0)).alias("daily_return"))


def long_intraday_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The slots of half months, with the fields of the hourly bars."""
    return long_intraday_spans(spark, folder).grid()


def long_intraday_spans(spark: SparkSession, folder: str) -> Spans:
    """The bars behind the slots of half months."""
    of = lambda c, v, x: F.sum(F.when(F.col(c) == v, F.col(x) if isinstance(x, str) else x).otherwise(0.0)).cast("double")
    one = F.lit(1.0)
    bars = _half_months(spark, folder).groupBy("date", "slot", "instrument").agg(
        F.avg("px").alias("mid_price"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").cast("double").alias("volume"), F.sum("l_extendedprice").cast("double").alias("amount"),
        of("l_returnflag", "R", "l_extendedprice").alias("buy_amount"), of("l_returnflag", "A", "l_extendedprice").alias("sell_amount"),
        of("l_linestatus", "O", one).alias("bid_volume1"), of("l_linestatus", "F", one).alias("ask_volume1"),
    )
    sides = {"bid_price1": F.when(F.col("bid_volume1") > 0, F.col("mid_price") * 0.9995).otherwise(0.0), "ask_price1": F.when(F.col("ask_volume1") > 0, F.col("mid_price") * 1.0005).otherwise(0.0)}
    return _spans(bars.withColumns(sides), LONG_SLOTS)


def month_panel(spark: SparkSession, folder: str) -> DataFrame:
    """month, instrument (supplier), close, high, low, volume, amount, daily_return, alpha by shipping month."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = (
        read(spark, folder, "lineitem")
        .groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("date"), F.col("l_suppkey").alias("instrument"))
        .agg(
            F.avg(price).alias("close"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
            (F.avg("l_discount") - F.avg("l_tax")).alias("alpha"),
        )
    )
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("date"))
    return bars.withColumn("daily_return", F.coalesce(ln(ratio("close", before)), F.lit(0.0))).withColumn("factor", F.lit(1.0))


def pred_panel(spark: SparkSession, folder: str, horizons=(1, 2, 3), window: int = 5) -> DataFrame:
    """date, instrument, pred (momentum of the close), gt_h (log returns ahead) on the dense daily grid."""
    w = Window.partitionBy("instrument").orderBy("date")
    d = dense_daily(daily_panel(spark, folder))
    gts = [(ln(F.lead("close", h).over(w)) - ln("close")).alias(f"gt_{h}") for h in horizons]
    return d.select("date", "instrument", ((ln("close") - ln(F.lag("close", window).over(w))) / F.sqrt(F.lit(float(window)))).alias("pred"), *gts)
