"""Panel algebra on tidy frames (time, instrument, fields): schema, selection, grids, filling, adjusting, aligning.

A dense panel has a row for every instrument and grid time. Filling follows one policy: flows
are zero where there was no bar, levels keep the last bar's value even if that was missing, and
values before the first bar stay missing unless they are filled backwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

TIME_NAMES = ("datetime", "timestamp")
INSTRUMENT_NAMES = ("instrument", "instruments", "stock_code")
ZERO_FIELDS = ("volume", "turnover", "amount", "daily_return")


def normalize(df: DataFrame) -> DataFrame:
    """Columns found by their usual names and called datetime and instrument; NaN becomes NULL."""
    from tidegrid.functions import without_nan

    def one(names: Sequence[str]) -> str:
        for n in names:
            if n in df.columns:
                return n
        raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")

    return without_nan(df.withColumnsRenamed({one(TIME_NAMES): "datetime", one(INSTRUMENT_NAMES): "instrument"}))


def fields(df: DataFrame, wanted: Sequence[str], keys: Sequence[str] = ("date", "instrument"), valid_only: bool = False) -> DataFrame:
    out = df.where("is_valid") if valid_only else df
    return out.select(*keys, *wanted)


def between(df: DataFrame, start=None, end=None, time: str = "date") -> DataFrame:
    """Rows from start to end, both included; None leaves that end open."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    return df if end is None else df.where(F.col(time) <= F.lit(end))


def with_more_rows_than(df: DataFrame, n: int, instrument: str = "instrument") -> DataFrame:
    """Rows of instruments with more than n rows; counts are aggregated before the join."""
    enough = df.groupBy(instrument).agg(F.count("*").alias("_n")).where(F.col("_n") > n).select(instrument)
    return df.join(enough, instrument, "left_semi")


def with_recent_rows(df: DataFrame, n: int, days: int, instrument: str = "instrument", time: str = "date") -> DataFrame:
    """Rows that have more than n observed rows of their instrument in the `days` calendar days up to them."""
    w = Window.partitionBy(instrument).orderBy(F.unix_date(time)).rangeBetween(-days, 0)
    return df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") > n).drop("_n")


def in_order(df: DataFrame, by: str = "datetime-first", time: str = "date", instrument: str = "instrument") -> DataFrame:
    """Sorted inside partitions; 'none' leaves the rows alone."""
    keys = {"datetime-first": (time, instrument), "instrument-first": (instrument, time), "none": ()}[by]
    return df.sortWithinPartitions(*keys) if keys else df


def time_grid(spark: SparkSession, day: str, step_minutes: int = 1, sessions=(("09:30", "11:30"), ("13:00", "14:57")), before: str | None = "09:25") -> DataFrame:
    """datetime and slot: the opening auction and then every step of each half-open session of a day."""
    parts = [spark.sql(f"SELECT timestamp_ntz'{day} {before}' AS datetime")] if before else []
    for a, b in sessions:
        parts.append(
            spark.sql(f"SELECT explode(sequence(timestamp_ntz'{day} {a}', timestamp_ntz'{day} {b}', interval {step_minutes} minute)) AS datetime").where(f"datetime < timestamp_ntz'{day} {b}'")
        )
    grid = reduce(DataFrame.union, parts).distinct()
    return grid.withColumn("slot", F.row_number().over(Window.orderBy("datetime")) - 1)  # one day's slots


def zero_filled(name: str) -> bool:
    return name in ZERO_FIELDS or name.endswith("diff")


def last_bar(x: str | Column, bar: str | Column, w) -> Column:
    """The value of x in the last row that was a bar, missing or not."""
    c = F.col(x) if isinstance(x, str) else x
    return F.last(F.when(F.col(bar) if isinstance(bar, str) else bar, F.struct(c.alias("v"))), ignorenulls=True).over(w)["v"]


def fill_columns(df: DataFrame, by: Sequence[str], time: str, columns: Sequence[str], zero: Iterable[str] | None = None, bar: Column | None = None, none: Iterable[str] = ()) -> DataFrame:
    """Fills gaps between bars. bar: where a row was observed (by default: any of the columns is there)."""
    zero = {c for c in columns if zero_filled(c)} if zero is None else set(zero)
    none = set(none)
    marked = df.withColumn("_bar", F.coalesce(*columns).isNotNull() if bar is None else bar)
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(c, F.lit(0.0)) if c in zero and c not in none else F.col(c) if c in none else last_bar(c, "_bar", w) for c in columns
    }
    # A zero-filled column keeps an observed NULL: only rows without a bar are zero.
    filled = {c: F.when(F.col("_bar"), F.col(c)).otherwise(F.lit(0.0)) if c in zero and c not in none else e for c, e in filled.items()}
    return marked.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a stored table, compressed, of which one task works out every factor: some 25 times as much in its memory.
SHARE = 8 << 20


def by_size(df: DataFrame) -> int:
    """A number of partitions for what is worked out from the tables behind df: one for each SHARE of the largest of them.

    At least a quarter of those of other exchanges (and 8, where there are so many): a few megabytes become every factor behind them. Not more without need, as
    every task writes the code of all its projections anew, which takes it seconds for a hundred factors.
    """
    every = partitions(df.sparkSession)
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    size = max(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(min(every, max(8, every // 4)), min(-(-size // SHARE), 8 * every))


def calendar(df: DataFrame, time: str) -> DataFrame:
    """One row with the sorted distinct times: as many as trading days, whatever the number of instruments."""
    return df.groupBy(time).agg(F.lit(1)).agg(F.sort_array(F.collect_list(time)).alias("_times"))


def densify(df: DataFrame, time: str = "date", instrument: str = "instrument", instruments: DataFrame | None = None, zero: Iterable[str] | None = None, none: Iterable[str] = (), ffill: bool = True, parts: int | None = None) -> DataFrame:
    """Every instrument on every time of the panel's own calendar. Of rows with equal keys the last by value stays.

    instruments: a list to align to instead of the panel's own. The calendar is one row, so the grid is
    made by exploding it beside each instrument, without a cartesian product of two tables.
    parts: deals the rows by instrument into so many partitions.
    """
    columns = [c for c in df.columns if c not in (time, instrument)]
    who = df.select(instrument).distinct() if instruments is None else instruments.select(instrument).distinct()
    # A fixed number of partitions: the list of instruments is small beside the windows worked out behind it.
    who = who.repartitionByRange(partitions(df.sparkSession), instrument)
    grid = who.join(F.broadcast(calendar(df, time)), how="cross").select(F.explode("_times").alias(time), instrument)
    rows = df.withColumn("_seen", F.lit(True))
    joined = grid.join(rows, [time, instrument], "left")
    joined = joined if parts is None else joined.repartition(parts, instrument)
    if not ffill:
        return joined.drop("_seen")
    out = fill_columns(joined, [instrument], time, columns, zero=zero, none=none, bar=F.coalesce("_seen", F.lit(False)))
    return out.select(time, instrument, *columns)


def last_of_slot(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of several rows on one slot the last by `order`, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def backfill(df: DataFrame, by: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Every missing value takes the next one there is.

    The rows are walked backwards: a frame that ends at the last row would be read anew for each row.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def validity(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("instrument",), max_missing: int = 0) -> DataFrame:
    """is_valid: fewer than max_missing missing values in every column, or by default any value in the first column."""
    w = Window.partitionBy(*by)
    if max_missing > 0:
        worst = F.greatest(*[F.count_if(F.col(c).isNull()).over(w) for c in columns]) if len(columns) > 1 else F.count_if(F.col(columns[0]).isNull()).over(w)
        return df.withColumn("is_valid", worst < max_missing)
    return df.withColumn("is_valid", F.count(columns[0]).over(w) > 0)


def adjusted(df: DataFrame, columns: Sequence[str], last: bool = True, factor: str = "factor", instrument: str = "instrument", time: str = "date") -> DataFrame:
    """adjusted_x for each x, anchored at the instrument's last (or first) factor in the slice.

    Prices: x / factor * anchor. Volumes, turnover and amounts: x * factor / anchor.
    """
    w = Window.partitionBy(instrument).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = (F.last if last else F.first)(factor, ignorenulls=True).over(w)
    flows = ("volume", "turnover", "amount")
    new = {f"adjusted_{c}": F.try_divide(F.col(c) * F.col(factor), anchor) if c in flows else F.try_divide(F.col(c), F.col(factor)) * anchor for c in columns}
    return df.withColumns(new)


def merge(a: DataFrame, b: DataFrame, how: str = "left", keys: Sequence[str] = ("date", "instrument")) -> DataFrame:
    return a.join(b, list(keys), how)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("date", "instrument")) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def align(df: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("date", "instrument"), strict: bool = True) -> DataFrame:
    """The rows with the wanted keys; with strict, a wanted key that is absent fails the query."""
    keys = list(keys)
    out = df.join(wanted.select(*keys).distinct(), keys, "left_semi")
    if not strict:
        return out
    missing = wanted.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti").limit(1)
    if missing.take(1):
        raise KeyError(f"keys of {', '.join(keys)} that the panel lacks")
    return out


def side_by_side(series: Sequence[DataFrame], keys: Sequence[str] = ("date", "instrument")) -> DataFrame:
    """Named series joined on their keys, gaps missing."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), series)


def all_positive(conditions: Sequence[str]) -> Column:
    """Whether all of the flag columns are positive; missing where one of them is."""
    return reduce(lambda a, b: a & b, [F.col(c) > 0 for c in conditions])


def every(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows where all of the flag columns are positive."""
    return df.where(all_positive(conditions))


def execution_period(df: DataFrame, period: str = "all", stride: int = 1, slot: str = "slot", slots: int = 24) -> DataFrame:
    """Every stride-th slot of the whole day, its last eighth (close) or its first (open)."""
    kept = -(-slots // stride)
    df = df.where(F.col(slot) % stride == 0)
    place = F.floor(F.col(slot) / stride)
    return {"all": df, "close": df.where(place >= kept // 8 * 7), "open": df.where(place < kept // 8)}[period]


#: Minutes since the session opened at which the stride changes: (first, last, stride).
STRIDES = ((0, 10, 1), (10, 30, 2), (30, 90, 5), (90, 120, 2), (120, 130, 1), (130, 210, 5), (210, 230, 2), (230, 240, 1))


def sample_minutes(strides=STRIDES) -> list[int]:
    return sorted({m for a, b, s in strides for m in range(a, b, s)})


def first_at_or_after(df: DataFrame, marks: Sequence[int], minute: str, by: Sequence[str]) -> DataFrame:
    """For each mark the first row of a day at or after it, each row once: an as-of match done by one window over marks and rows.

    The next mark is found without a join: marks are an array literal and each row looks up the last
    mark not above it; it is that mark's match if no earlier row of the day has the same last mark.
    """
    own = F.aggregate(F.array(*[F.lit(int(m)) for m in marks]), F.lit(-1), lambda a, m: F.when(m <= F.col(minute), F.greatest(a, m)).otherwise(a))
    w = Window.partitionBy(*by).orderBy(minute)
    return df.withColumn("_m", own).withColumn("_p", F.lag("_m").over(w)).where((F.col("_m") >= 0) & (F.col("_p").isNull() | (F.col("_p") < F.col("_m")))).drop("_p").withColumnRenamed("_m", "mark")


def on_grid(df: DataFrame, grid: DataFrame, time: str, at: str = "datetime", name: str = "slot") -> DataFrame:
    """Adds the grid's slot of exactly the row's time; missing where the grid has no such time."""
    return df.join(grid.select(F.col(at).alias(time), F.col(name)), time, "left")


def session_marks(days: DataFrame, minutes: Sequence[int] | None = None, day: str = "date", name: str = "ts") -> DataFrame:
    """The rows of `days`, each with every sampled minute of its two sessions (from 9:30 and from 13:00, 120 minutes each) as a timestamp."""
    minutes = sample_minutes() if minutes is None else minutes
    seconds = F.array(*[F.lit((570 + m if m < 120 else 660 + m) * 60) for m in minutes])
    marked = days.withColumns({"minute": F.explode(F.array(*[F.lit(m) for m in minutes]))})
    return marked.withColumn(name, F.timestamp_seconds(F.unix_seconds(F.col(day).cast("timestamp")) + F.get(seconds, F.array_position(F.array(*[F.lit(m) for m in minutes]), F.col("minute")).cast("int") - 1)))


def as_of(marks: DataFrame, ticks: DataFrame, by: Sequence[str], time: str, values: Sequence[str], tolerance: str | None = None, tie: str | None = None, width: str = "1 day") -> DataFrame:
    """Each mark with the values (and _at, the time) of the last tick of its key at or before it; none where that is older than the tolerance.

    Marks and ticks are merged by one sort in spans of `width`, so that a key with very many ticks is
    spread over its spans. What a span's first marks need of earlier spans comes from the spans' last ticks: an
    aggregate with a row a span. Ticks of one time: the one with the largest `tie` counts. No theta join.
    """
    span = F.floor(F.unix_seconds(F.col(time)) / F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {width}")))
    place = F.struct(time, *([tie] if tie else []))
    held = F.struct(F.col(time).alias("_at"), *values)
    rest = [c for c in marks.columns if c not in (*by, time)]
    m = marks.select(*by, time, span.alias("_span"), F.struct(*rest).alias("_mark") if rest else F.lit(True).alias("_mark"), F.lit(1).alias("_kind"))
    t = ticks.select(*by, time, span.alias("_span"), held.alias("_tick"), place.alias("_place"), F.lit(0).alias("_kind"))
    both = t.unionByName(m, allowMissingColumns=True)
    lasts = both.groupBy(*by, "_span").agg(F.max_by("_tick", "_place").alias("_last"))
    over = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*by, "_span", F.last("_last", ignorenulls=True).over(over).alias("_carried"))
    merge = Window.partitionBy(*by, "_span").orderBy(time, "_kind", "_place").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_tick", ignorenulls=True).over(merge)).where("_kind = 1")
    found = seen.join(carried, [*by, "_span"]).withColumn("_found", F.coalesce("_seen", "_carried"))
    if tolerance is not None:
        found = found.withColumn("_found", F.when(F.col(time) <= F.col("_found._at") + F.expr(f"INTERVAL {tolerance}"), F.col("_found")))
    return found.select(*by, time, *([f"_mark.{c}" for c in rest]), F.col("_found._at").alias("_at"), *[F.col(f"_found.{v}").alias(v) for v in values])


def one_random_slot(df: DataFrame, seed: int, by: Sequence[str] = ("date", "instrument"), slot: str = "slot", period: tuple[int, int] | None = None, valid: str | None = None, selector: Column | None = None) -> DataFrame:
    """One row of each group, drawn by a hash of the seed, the group and the slot; position is its place in 240 minutes.

    valid: a flag that a group's rows need to take part; selector: what the drawn row must fulfil to stay (it is not drawn anew).
    """
    a, b = period or (0, 24)
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, slot), slot)
    inside = df.where((F.col(slot) >= a) & (F.col(slot) < b))
    inside = inside if valid is None else inside.where(F.col(valid))
    drawn = inside.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    kept = drawn if selector is None else drawn.where(selector)
    return kept.withColumn("position", F.floor((F.col(slot) - a) / F.lit(float(b - a)) * 240).cast("int"))


def _gap(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull() | (F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))


def counting_gaps(df: DataFrame, columns: Sequence[str], name: str = "gaps") -> tuple[DataFrame, Observation]:
    """df, and what has been seen of it once it has been read whole: rows, and missing values and NaNs of each column, counted as the rows go by."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(_gap(df, c)).alias(c) for c in columns]), seen


def gap_report(df: DataFrame, columns: Sequence[str], sink: Callable[[DataFrame], None]) -> DataFrame:
    """column, rows, gaps of what the sink took in: no pass of its own."""
    watched, seen = counting_gaps(df, columns)
    sink(watched)
    got = seen.get
    return df.sparkSession.createDataFrame([(c, got["rows"], got[c]) for c in columns], "column string, rows long, gaps long")


def without_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, whose named columns may hold no missing value and no NaN: a row that does fails the query when it is read."""
    kinds = dict(df.dtypes)
    gap = reduce(lambda x, y: x | y, [_gap(df, c) for c in columns])
    first = columns[0]
    return df.withColumn(first, F.when(gap, F.raise_error(F.lit("a missing value in the batch")).cast(kinds[first])).otherwise(F.col(first)))


def trailing(df: DataFrame, time: str, until, n: int | None = None, by: str = "instrument") -> DataFrame:
    """What a cursor at `until` has seen: rows up to and with it, or the last n of them of each instrument."""
    seen = df.where(F.col(time) <= F.lit(until))
    if n is None:
        return seen
    w = Window.partitionBy(by).orderBy(F.desc(time))
    return seen.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def train_part(df: DataFrame, start, end, time: str = "date") -> DataFrame:
    """Dates from start up to but without end."""
    return df.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def missing_dates(available: DataFrame, done: DataFrame, time: str = "date") -> DataFrame:
    """The dates still to be worked on."""
    return available.select(time).distinct().join(done.select(time).distinct(), time, "left_anti")
