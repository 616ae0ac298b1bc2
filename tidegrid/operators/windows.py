"""Window operators: history before the day, the running day, and the days ahead.

All are Columns over one of three layouts, so equal layouts share one exchange and one sort:
history and future by (instrument; date) on the dense daily grid, the running day by
(instrument, date; slot) on the dense intraday grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions import col, ln

#: From this length on, window sums are differences of running sums (linear in rows, whatever the length).
PREFIX_FROM = 63


def days(instrument: str = "instrument", time: str = "date") -> WindowSpec:
    return Window.partitionBy(instrument).orderBy(time)


def today(instrument: str = "instrument", date: str = "date", slot: str = "slot") -> WindowSpec:
    return Window.partitionBy(instrument, date).orderBy(slot)


def before(w: int, over: WindowSpec | None = None) -> WindowSpec:
    """The last w grid days before the day itself."""
    if w < 1:
        raise ValueError("a history window has at least one day")
    return (over or days()).rowsBetween(-w, -1)


def ahead(w: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or days()).rowsBetween(1, w)


def so_far(over: WindowSpec | None = None) -> WindowSpec:
    return (over or today()).rowsBetween(Window.unboundedPreceding, 0)


# History -----------------------------------------------------------------


def yesterday(x) -> Column:
    return F.lag(col(x), 1).over(days())


def pow_sum(x, power: int, w: int) -> Column:
    """Sum of x^power over the w days before, NULL skipped and 0 if there is none; power 0 counts."""
    if w < 1:
        return F.lit(0.0)
    if power == 0:
        return F.count(col(x)).over(before(w)).cast("double")
    term = col(x)
    for _ in range(power - 1):
        term = term * col(x)
    return F.coalesce(F.sum(term).over(before(w)), F.lit(0.0))


def product_sum(a, b, w: int) -> Column:
    return F.coalesce(F.sum(col(a) * col(b)).over(before(w)), F.lit(0.0)) if w >= 1 else F.lit(0.0)


def product_count(a, b, w: int) -> Column:
    return F.count(col(a) * col(b)).over(before(w)).cast("double") if w >= 1 else F.lit(0.0)


def high(x, w: int) -> Column:
    return F.max(col(x)).over(before(w))


def low(x, w: int) -> Column:
    return F.min(col(x)).over(before(w))


def recent(x, over: WindowSpec | None = None) -> Column:
    """The last value up to the row that is not missing."""
    return F.last(col(x), ignorenulls=True).over((over or days()).rowsBetween(Window.unboundedPreceding, 0))


def lag_filled(x, w: int) -> Column:
    """The value w days back, or the last one there was before that: a frame that ends w days back."""
    return F.last(col(x), ignorenulls=True).over(days().rowsBetween(Window.unboundedPreceding, -w))


def mean(x, w: int) -> Column:
    return F.avg(col(x)).over(before(w))


def valid_ratio(x, w: int) -> Column:
    return F.count(col(x)).over(before(w)) / F.lit(float(w))


def vwap(price, volume, w: int) -> Column:
    """sum(p v) / (sum(v) + 1e-6), the plain mean where nothing traded."""
    total = F.coalesce(F.sum(col(volume)).over(before(w)), F.lit(0.0))
    traded = F.coalesce(F.sum(col(price) * col(volume)).over(before(w)), F.lit(0.0))
    return F.when(total == 0, mean(price, w)).otherwise(traded / (total + 1e-6))


def winsorized(x, w: int, sigmas: float = 3.0) -> Column:
    """x inside +-sigmas root mean squares of the w days before."""
    bound = F.sqrt(F.avg(col(x) * col(x)).over(before(w))) * sigmas
    return F.when(bound.isNull() | col(x).isNull(), col(x)).otherwise(F.greatest(F.least(col(x), bound), -bound))


def rolling_moment(x, power: int, w: int) -> Column:
    """Sum of x^power over the w days up to the row, over w; missing in the first w - 1 rows."""
    term = col(x)
    for _ in range(power - 1):
        term = term * col(x)
    frame = days().rowsBetween(-(w - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= w, F.coalesce(F.sum(term).over(frame), F.lit(0.0)) / w)


def with_history_sums(df: DataFrame, sums: Mapping[str, tuple[Column, int]], over: WindowSpec | None = None) -> DataFrame:
    """Adds each named sum of a term over its w days before, 0 where there is none.

    Short windows are frames; long ones are differences of one running sum for each term, so that their
    cost does not grow with the window. All of them need one sort.
    """
    over = over or days()
    runs = {str(t): (f"_c{i}", t) for i, t in enumerate({str(t): t for t, w in sums.values() if w >= PREFIX_FROM}.values())}
    df = df.withColumns({name: F.coalesce(F.sum(t).over(so_far(over)), F.lit(0.0)) for name, t in runs.values()}) if runs else df
    new = {}
    for name, (term, w) in sums.items():
        if w >= PREFIX_FROM:
            c = F.col(runs[str(term)][0])
            new[name] = F.coalesce(F.lag(c, 1).over(over), F.lit(0.0)) - F.coalesce(F.lag(c, w + 1).over(over), F.lit(0.0))
        else:
            new[name] = F.coalesce(F.sum(term).over(before(w, over)), F.lit(0.0)) if w else F.lit(0.0)
    return df.withColumns(new).drop(*[n for n, _ in runs.values()])


# The running day -----------------------------------------------------------


def opening(x) -> Column:
    return F.first(col(x)).over(so_far())


def change(x, slot: str = "slot") -> Column:
    """First difference; the first slot keeps its value."""
    return F.when(F.row_number().over(today()) == 1, col(x)).otherwise(col(x) - F.lag(col(x), 1).over(today()))


def total(x) -> Column:
    return F.sum(F.coalesce(col(x), F.lit(0.0))).over(so_far())


def _unbroken(x, value: Column) -> Column:
    return F.when(F.count(col(x)).over(so_far()) == F.count(F.lit(1)).over(so_far()), value)


def high_so_far(x) -> Column:
    """Running maximum, missing from the first missing value on."""
    return _unbroken(x, F.max(col(x)).over(so_far()))


def low_so_far(x) -> Column:
    return _unbroken(x, F.min(col(x)).over(so_far()))


def time_fraction(slots: int) -> Column:
    return F.row_number().over(today()) / F.lit(float(slots))


# Days ahead ------------------------------------------------------------------


def future(x, w: int) -> Column:
    """The value w days ahead on the filled grid; 0 is the day itself."""
    return F.lead(col(x), w).over(days()) if w else col(x)


def future_high(x, w: int) -> Column:
    return F.max(col(x)).over(ahead(w))


def future_low(x, w: int) -> Column:
    return F.min(col(x)).over(ahead(w))


def future_sum(x, w: int) -> Column:
    return F.coalesce(F.sum(col(x)).over(ahead(w)), F.lit(0.0))


def return_ahead(price, w: int) -> Column:
    """Log return to w slots ahead, at most to the last slot; w = -1: to the close."""
    close = F.last(col(price)).over(today().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    to = close if w < 0 else F.coalesce(F.lead(col(price), w).over(today()), close)
    return ln(to) - ln(price)


def ewma(df: DataFrame, x: str, decay: float, by: Sequence[str], time: str) -> DataFrame:
    """s_n = decay s_(n-1) + (1 - decay) x_n from s_0 = x_0, in closed form: a fold over each key's ordered history."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(x).over(w)
    value = F.aggregate(F.slice(seen, 2, F.greatest(F.size(seen) - 1, F.lit(0))), F.get(seen, F.lit(0)), lambda a, v: a * decay + v * (1 - decay))
    return df.withColumn("ewma", value)
