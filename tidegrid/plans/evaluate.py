"""Evaluation of predictions: daily metrics, summaries over days, metric tables, quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators import xsection as xs

METRICS: dict[str, tuple[Callable[..., DataFrame], str]] = {}


def register_metric(name: str, column: str):
    def put(f):
        METRICS[name] = f, column
        return f

    return put


register_metric("ic", "rank_ic")(xs.rank_ic)
register_metric("long_ic", "long_ic")(xs.long_rank_ic)
register_metric("tiered_returns", "spread")(xs.tiered_returns)
register_metric("long_precision", "precision")(xs.precision)
register_metric("coverage", "coverage")(xs.coverage)
register_metric("interval_width", "interval_width")(xs.coverage)


def metric_table(df: DataFrame, schemas: Sequence[tuple[str, str, Sequence[str], Sequence[str]]], by: Sequence[str]) -> DataFrame:
    """One row for each group with a column name_metric_target for each part; schemas: (name, prediction, targets, metrics)."""
    parts = []
    for name, pred, gts, metrics in schemas:
        for gt in gts:
            for m in metrics:
                f, column = METRICS[m]
                parts.append(f(df, pred, gt, by).select(*by, F.col(column).alias(f"{name}_{m}_{gt}")))
    return reduce(lambda a, b: a.join(b, list(by), "full"), parts)


#: The metrics of a cross-section, each averaged over a day's slots.
DAILY = ("ic", "rank_ic", "rank_ic_long", "rank_ic_short", "hit_rate", "auc", "top", "bottom", "spread", "monotonicity", "tail")


def cross_section_metrics(
    df: DataFrame, pred: str, horizons: Sequence[str], by: Sequence[str] = ("date",), day: str = "date", least: int = 20, q: int = 10, tops: Sequence[int] = (20, 50, 100), tie: str = "instrument"
) -> DataFrame:
    """by, horizon, n, DAILY and quantile_returns (q bucket means, then the means of the top rows) of each cross-section.

    The horizons are unpivoted once; all ranks are windows over (by, horizon), so one exchange serves
    every metric. Ranks are averaged over ties and taken among all predictions (outcomes) there are;
    correlations need `least` pairs, buckets and tails max(50, 5 q). The long (short) half has ranks at
    or above (below) the median. A hit is a prediction over the day's median with a positive outcome, or neither.
    """
    long = df.select(*by, tie, F.col(pred).alias("_p"), F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(h).alias("g")) for h in horizons])).alias("s")).select(*by, tie, "_p", "s.horizon", F.col("s.g").alias("_g"))
    group = [*by, "horizon"]
    up_p, up_g = (Window.partitionBy(*group).orderBy(F.col(c).asc_nulls_last()) for c in ("_p", "_g"))
    whole = Window.partitionBy(*group)
    average = lambda c, w: F.when(F.col(c).isNotNull(), (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))) / 2.0)
    ranked = long.withColumns({"_rp": average("_p", up_p), "_i": F.row_number().over(up_p), "_rg": average("_g", up_g)})
    there = F.count("_p").over(whole)
    middle = lambda at: F.max(F.when(F.col("_i") == at, F.col("_rp"))).over(whole)
    ok = F.col("_p").isNotNull() & F.col("_g").isNotNull()
    placed = ranked.withColumns({"_ok": ok, "_m": (middle(F.ceil(there / 2.0)) + middle(F.floor(there / 2.0) + 1)) / 2.0, "_n": F.count(F.when(ok, 1)).over(whole)})
    pairs = Window.partitionBy(*group, "_ok")
    placed = placed.withColumn("_k", F.row_number().over(pairs.orderBy("_p", tie)) - 1)
    placed = placed.withColumn("_ranks_up", average("_p", pairs.orderBy("_p")))
    middles = day_medians(df.select(F.col(day).alias("_day"), F.col(pred).alias("_p")))
    placed = placed.join(F.broadcast(middles), F.col(day).eqNullSafe(F.col("_day")), "left").drop("_day")  # a row a day
    n, k, g = F.col("_n"), F.col("_k"), F.col("_g")
    corr = lambda x, y, c: F.when(F.count(F.when(c, 1)) >= least, xs.correlation(F.when(c, x), F.when(c, y)))
    mean = lambda c: F.avg(F.when(F.col("_ok") & c, g))
    some, up = F.col("_ok"), F.col("_g") > 0
    ones = F.count_if(some & up)
    area = F.try_divide(F.sum(F.when(some & up, F.col("_ranks_up"))) - ones * (ones + 1) / 2.0, ones * (F.max("_n") - ones))
    enough, share = F.max("_n") >= max(50, 5 * q), F.greatest(F.lit(1), F.rint(0.01 * n))
    bucket = F.floor(F.try_divide((k + 1) * q - 1, n))
    means = [mean(bucket == i) for i in range(q)]
    out = placed.groupBy(*group).agg(
        F.max("_n").alias("n"),
        corr(F.col("_p"), g, some).alias("ic"),
        corr(F.col("_rp"), F.col("_rg"), some).alias("rank_ic"),
        corr(F.col("_rp"), F.col("_rg"), some & (F.col("_rp") >= F.col("_m"))).alias("rank_ic_long"),
        (-corr(F.col("_rp"), F.col("_rg"), some & (F.col("_rp") <= F.col("_m")))).alias("rank_ic_short"),
        F.when(F.max("_n") >= least, F.avg(F.when(some, ((F.col("_p") > F.col("_t")) == up).cast("double")))).alias("hit_rate"),
        F.when((F.max("_n") >= 20) & (ones > 0) & (ones < F.max("_n")), area).alias("auc"),
        F.when(enough, mean(k >= n - share) - mean(k < share)).alias("tail"),
        F.when(enough, F.array(*means, *[mean(k >= n - c) for c in tops])).alias("quantile_returns"),
    )
    buckets = F.slice("quantile_returns", 1, q)
    rank = lambda m: F.size(F.filter(buckets, lambda x: x < m)) + (F.size(F.filter(buckets, lambda x: x == m)) + 1) / 2.0
    # Spearman of the bucket's number and its mean: both sets of ranks have the mean (q + 1) / 2.
    off = F.transform(buckets, lambda m, i: F.struct((i + 1 - (q + 1) / 2.0).alias("a"), (rank(m) - (q + 1) / 2.0).alias("b")))
    total = lambda f: F.aggregate(F.transform(off, f), F.lit(0.0), lambda a, x: a + x)
    return out.withColumns(
        {
            "top": F.get("quantile_returns", F.lit(q + len(tops) - 1)),
            "bottom": F.get("quantile_returns", F.lit(0)),
            "spread": F.get("quantile_returns", F.lit(q - 1)) - F.get("quantile_returns", F.lit(0)),
            "monotonicity": F.try_divide(total(lambda x: x["a"] * x["b"]), F.sqrt(total(lambda x: x["a"] * x["a"]) * total(lambda x: x["b"] * x["b"]))),
        }
    ).select(*group, "n", *DAILY, "quantile_returns")


def day_medians(rows: DataFrame) -> DataFrame:
    """_day, _t: the median of each day's _p, from the counts of its values: partial before the exchange, and no day is held in a task."""
    day = Window.partitionBy("_day")
    counts = rows.where("_p IS NOT NULL").groupBy("_day", "_p").agg(F.count("*").alias("_n"))
    run = counts.select("_day", "_p", F.sum("_n").over(day.orderBy("_p")).alias("_upto"))
    sizes = counts.groupBy("_day").agg(F.sum("_n").alias("_all"))
    first = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_p")))
    both = run.join(F.broadcast(sizes.withColumnRenamed("_day", "_d")), F.col("_day").eqNullSafe(F.col("_d")))
    return both.groupBy("_day").agg((0.5 * first(F.floor((F.col("_all") + 1) / 2)) + 0.5 * first(F.ceil((F.col("_all") + 1) / 2))).alias("_t"))


def daily_metrics(df: DataFrame, pred: str, horizons: Sequence[str], slot: str | None = None, day: str = "date", least: int = 20, q: int = 10, tops: Sequence[int] = (20, 50, 100)) -> DataFrame:
    """day, horizon and the metrics of each cross-section averaged over the day's slots; slots without a value are left out."""
    by = [day, slot] if slot else [day]
    every = cross_section_metrics(df, pred, horizons, by, day, least, q, tops)
    returns = F.array(*[F.avg(F.get("quantile_returns", F.lit(i))) for i in range(q + len(tops))])
    return every.groupBy(day, "horizon").agg(*[F.avg(m).alias(m) for m in DAILY], returns.alias("quantile_returns"))


def summary(daily: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """horizon, and mean and sample deviation over days of each metric."""
    aggs: list[Column] = [F.count("*").alias("n_days")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return daily.groupBy("horizon").agg(*aggs)


def top_horizons(summed: DataFrame, metric: str, k: int = 2) -> DataFrame:
    """rank, horizon: the k horizons with the largest absolute mean of a metric; ties go to the lesser name."""
    some = F.filter(F.collect_list(F.when(F.col(f"{metric}_mean").isNotNull(), F.struct((-F.abs(f"{metric}_mean")).alias("v"), "horizon"))), lambda x: x.isNotNull())
    best = F.slice(F.sort_array(some), 1, k)
    return summed.agg(best.alias("b")).select(F.posexplode("b").alias("i", "x")).select((F.col("i") + 1).alias("rank"), "x.horizon")


def peak_horizon(summed: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """For each metric the horizon with the largest absolute mean."""
    return summed.agg(*[F.max_by("horizon", F.when(F.col(f"{m}_mean").isNotNull(), F.struct(F.abs(f"{m}_mean"), F.col("horizon")))).alias(f"{m}_peak") for m in metrics])


def quantile_sketches(df: DataFrame, values: Sequence[str], k: int = 800, by: Sequence[str] = ()) -> DataFrame:
    """by, horizon and a mergeable sketch of its values: partial sketches combine before the exchange and across days."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("horizon"), F.col(v).cast("double").alias("v")) for v in values])).alias("s")).select(*by, "s.*").where("v IS NOT NULL")
    return long.groupBy(*by, "horizon").agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def sketch_ranks(sketches: DataFrame, points: Sequence[float]) -> DataFrame:
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("x"), F.kll_sketch_get_rank_double("sketch", F.lit(float(p))).alias("cdf")) for p in points])
    return sketches.select("horizon", F.explode(ranks).alias("r")).select("horizon", "r.x", "r.cdf")


LEVELS = (0.9, 0.95, 0.99, 0.999, 0.9999)


def merged(sketches: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """One sketch for each group of sketches: of days to a month, of parts to a whole."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """The other columns, level, upper and lower: what a tracker reports of both tails, from its sketch."""
    rest = [c for c in sketches.columns if c != "sketch"]
    at = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(float(x)))
    pairs = F.array(*[F.struct(F.lit(float(x)).alias("level"), at(x).alias("upper"), at(round(1 - x, 6)).alias("lower")) for x in levels])
    return sketches.select(*rest, F.explode(pairs).alias("t")).select(*rest, "t.*")


def brackets(sketches: DataFrame, levels: Sequence[float], margin: float) -> DataFrame:
    """The other columns and _bounds: an array of (low, high), the sketch's quantiles a margin below and above each level; nothing is outside with a margin of 1."""
    at = lambda x: F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(max(x, 0.0), 1.0))))
    low, high = (lambda x: F.lit(float("-inf")) if x <= 0 else at(x)), (lambda x: F.lit(float("inf")) if x >= 1 else at(x))
    bounds = F.array(*[F.struct(low(x - margin).alias("low"), high(x + margin).alias("high")) for x in levels])
    return sketches.withColumn("_bounds", bounds).drop("sketch")


def bracketed(x: str) -> tuple[Column, Column]:
    """Whether a value lies in one of _bounds, and what it is counted as: itself there, otherwise the greatest bound under it."""
    v = F.col(x).cast("double")
    inside = F.exists("_bounds", lambda b: (v >= b["low"]) & (v <= b["high"]))
    under = F.array_max(F.transform("_bounds", lambda b: F.when(v > b["high"], b["high"]).otherwise(F.lit(float("-inf")))))
    return inside, F.when(inside, v).otherwise(under)


def counted_quantiles(counts: DataFrame, by: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """by, _settled and q (the value at each level: the first whose share reaches it) of counts (by, value, inside, n).

    What lies outside the brackets is counted together beside a bound; a level is settled where it falls on a value inside.
    """
    whole = Window.partitionBy(*by)
    upto = F.sum("n").over(whole.orderBy("value", "inside_last").rowsBetween(Window.unboundedPreceding, 0))
    # Values that are counted as the bound under them come after the bound itself.
    run = counts.withColumn("inside_last", (~F.col("inside")).cast("int")).withColumns({"_upto": upto, "_all": F.sum("n").over(whole)})
    first = lambda x: F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1.0), F.ceil(F.col("_all") * x)), F.struct("value", "inside_last")))
    got = run.groupBy(*by).agg(*[first(x).alias(f"_q{i}") for i, x in enumerate(levels)])
    names = [f"_q{i}" for i in range(len(levels))]
    return got.select(*by, (F.greatest(*[F.col(f"{c}.inside_last") for c in names], F.lit(0)) == 0).alias("_settled"), F.array(*[F.col(f"{c}.value") for c in names]).alias("q"))


#: Bits of a value that a pass settles.
DIGIT = 16


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit patterns in the order of the values; zeros of both signs are one value."""
    raw = (x + 0.0).view(np.uint64)
    return np.where(raw >> np.uint64(63) == 1, ~raw, raw | np.uint64(1) << np.uint64(63))


def _value_of(bits: int) -> float:
    raw = bits & (1 << 63) - 1 if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def order_statistics(df: DataFrame, values: Sequence[str], ranks: Callable[[int], Sequence[int]]) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """How many values each column has, and its values at the ranks (from 0) that `ranks` names for that number.

    Selection by refinement: a pass counts, for each prefix of bits in which a sought value lies, the values
    by their next DIGIT bits. A task fills its histograms as its rows go by, so what is exchanged is at
    most prefixes x 2^DIGIT counts a task whatever the input, no value is sorted or gathered, and four passes settle
    the 64 bits of a double. The driver holds the histograms of the prefixes sought: two for each rank at most.
    """
    columns = df.select(*[F.col(v).cast("double").alias(v) for v in values])

    def counted(shift: int, prefixes: dict[str, list[int]]) -> dict[tuple[str, int], np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(v, p): np.zeros(1 << DIGIT, np.int64) for v in values for p in prefixes[v]}
            for b in batches:
                for v in values:
                    x = b.column(v).drop_null().to_numpy(zero_copy_only=False)
                    bits = _ordered_bits(x[~np.isnan(x)])
                    digit = (bits >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                    head = bits >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros(len(bits), np.uint64)
                    for p in prefixes[v]:
                        sums[v, p] += np.bincount(digit[head == np.uint64(p)], minlength=1 << DIGIT)
            for (v, p), n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(some), pa.string()), pa.array([str(p)] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some])], ["v", "p", "digit", "n"])

        out = {(v, p): np.zeros(1 << DIGIT, np.int64) for v in values for p in prefixes[v]}
        for r in columns.mapInArrow(run, "v string, p string, digit int, n long").groupBy("v", "p", "digit").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["v"], int(r["p"])][r["digit"]] = r["n"]
        return out

    found = counted(64 - DIGIT, {v: [0] for v in values})
    sizes = {v: int(found[v, 0].sum()) for v in values}
    # What is sought: column, rank asked for, prefix known so far, rank within the prefix.
    sought = [(v, r, 0, r) for v in values if sizes[v] for r in sorted(set(ranks(sizes[v])))]
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if shift < 64 - DIGIT:
            found = counted(shift, {v: sorted({p for w, _, p, _ in sought if w == v}) for v in values})
        after = []
        for v, asked, p, r in sought:
            upto = found[v, p].cumsum()
            digit = int(np.searchsorted(upto, r, side="right"))
            after.append((v, asked, p << DIGIT | digit, r - int(upto[digit - 1] if digit else 0)))
        sought = after
    return sizes, {(v, asked): _value_of(p) for v, asked, p, _ in sought}


def exact_tails(df: DataFrame, values: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """horizon, level, upper and lower exact quantiles (interpolated), for checking a sketch; no group of values is held anywhere."""
    asked = sorted({float(q) for x in levels for q in (x, round(1 - x, 6))})
    sizes, at = order_statistics(df, values, lambda n: [i for q in asked for i in (math.floor((n - 1) * q), math.ceil((n - 1) * q))])

    def quantile(v: str, q: float) -> float | None:
        place = (sizes[v] - 1) * q
        if not sizes[v]:
            return None
        low, high = at[v, math.floor(place)], at[v, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    rows = [(v, float(x), quantile(v, float(x)), quantile(v, round(1 - x, 6))) for v in values if sizes[v] for x in levels]
    return df.sparkSession.createDataFrame(rows, "horizon string, level double, upper double, lower double")


def cumulative(daily: DataFrame, value: str, base: float = 0.0, by: Sequence[str] = ("horizon",), time: str = "date") -> DataFrame:
    """Running mean of value - base and running product of 1 + value over days: the series of a report's plots."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.when(F.col(value) > -1, F.log1p(value))).over(w))
    return daily.select(*by, time, F.avg(F.col(value) - base).over(w).alias("mean_so_far"), grown.alias("equity"))


def decay_table(daily: DataFrame, value: str, order: Sequence[str], day: str = "date") -> DataFrame:
    """step, horizon, n_days, mean, t and share (of the first horizon's mean) of a daily value: how it fades with the horizon."""
    step = F.array_position(F.array(*[F.lit(h) for h in order]), F.col("horizon"))
    sums = daily.where(F.col(value).isNotNull() & (step > 0)).groupBy("horizon").agg(F.count("*").alias("n_days"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    rows = sums.withColumns({"step": step, "t": F.try_divide(F.col("mean"), F.col("_sd") / F.sqrt("n_days"))})
    first = F.max(F.when(F.col("step") == 1, F.col("mean"))).over(Window.partitionBy(F.lit(1)))  # a row a horizon
    return rows.withColumn("share", F.try_divide("mean", first)).select("step", "horizon", "n_days", "mean", "t", "share")


def bucket_curve(buckets: DataFrame, of: Sequence[str] = (), value: str = "mean") -> DataFrame:
    """of, bucket, n_groups, n, mean, low, high: a bucket's mean over days (or slots) with the half width of its 95 % interval on both sides.

    buckets: what quantile_stats or value_buckets give, a row for each cross-section and bucket.
    """
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    mean = F.avg(value)
    return buckets.groupBy(*of, "bucket").agg(F.count(value).alias("n_groups"), F.sum("n").alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"))


def heat_map(df: DataFrame, value: str, rows: Column, columns: Column) -> DataFrame:
    """row, column, n, mean of a value by two of its dimensions."""
    return df.where(F.col(value).isNotNull()).groupBy(rows.alias("row"), columns.alias("column")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def save_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a Parquet folder of its name; a report made again takes the place of the old one."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def timing_stats(df: DataFrame, label: str, seconds: str, order: str, window: int = 20) -> DataFrame:
    """Moving mean, sample deviation and half width of the 95 % interval of the last `window` timings of each label."""
    w = Window.partitionBy(label).orderBy(order).rowsBetween(-(window - 1), 0)
    n, sd = F.count(seconds).over(w), F.stddev_samp(seconds).over(w)
    return df.select(label, order, seconds, F.avg(seconds).over(w).alias("mean"), sd.alias("std"), (1.96 * sd / F.sqrt(n)).alias("half_width"))
