"""Daily statistics as mergeable states: a day's state is computed once, stored, and merged forward.

A statistic is four things, each a built-in expression: `state`, aggregates over a day's rows;
`merge`, the state of an earlier and a later part from both; `finish`, the value of a state; and the
keys that it is kept for. Merging is associative in the order of time (it need not be commutative, so
decayed averages are statistics too).

`Stats` keeps two tables for each: `day`, the state of each date, and `upto`, the states of all dates up to a date
merged. Adding dates reads their rows and the last merged state only; no earlier row is read again. A rolling
window is the merged states of its dates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import ratio
from tidegrid.plans.online import exists, remove

State = Mapping[str, Column]


@dataclass(frozen=True)
class Stat:
    """keys: what a state is kept for; state: aggregates of a day's rows; merge(earlier, later): fields of the merged state; finish: columns from the fields of a state.

    by_merging, where given, merges any number of states in any order as one aggregate of each field.
    """

    keys: tuple[str, ...]
    state: Mapping[str, Column]
    merge: Callable[[State, State], State]
    finish: Callable[[State], Mapping[str, Column]]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    by_merging: Mapping[str, Column] | None = None


STATS: dict[str, Callable[..., Stat]] = {}


def register_stat(name: str):
    """Adds a maker of a statistic; its arguments are the statistic's parameters."""

    def put(make: Callable[..., Stat]):
        if name in STATS:
            raise ValueError(f"statistic {name} is registered already")
        STATS[name] = make
        return make

    return put


@register_stat("moments")
def moments(x: str, keys: Sequence[str] = ("instrument",)) -> Stat:
    """count, mean and deviation of x: counts, means and sums of squared deviations merge by the difference of means."""

    def merge(a: State, b: State) -> State:
        n = a["n"] + b["n"]
        off = b["mean"] - a["mean"]
        return {"n": n, "mean": F.coalesce(a["mean"] + ratio(off * b["n"], n), F.lit(0.0)), "square": a["square"] + b["square"] + F.coalesce(ratio(off * off * a["n"] * b["n"], n), F.lit(0.0))}

    v = F.col(x).cast("double")
    n = F.count(v).cast("double")
    return Stat(
        tuple(keys),
        {"n": n, "mean": F.coalesce(F.avg(v), F.lit(0.0)), "square": F.coalesce(F.var_pop(v) * n, F.lit(0.0))},
        merge,
        lambda s: {"n": s["n"], "mean": F.when(s["n"] > 0, s["mean"]), "std": F.when(s["n"] > 1, F.sqrt(ratio(s["square"], s["n"] - 1)))},
    )


@register_stat("volume_profile")
def volume_profile(decay: float = 0.95, volume: str = "volume", every: int = 6, keys: Sequence[str] = ("instrument", "slot")) -> Stat:
    """Each instrument's cumulative share of the day's volume at every every-th slot, averaged over days with a decay.

    s_n = decay s_(n-1) + (1 - decay) x_n from s_0 = x_0. A part's state is its number of days, its first
    value and the decayed sum of the others; before an earlier part, the first value weighs like the others.
    """

    def prepare(df: DataFrame) -> DataFrame:
        day = Window.partitionBy("instrument", "date")
        so_far = day.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        share = ratio(F.sum(F.coalesce(volume, F.lit(0.0))).over(so_far), F.sum(volume).over(day))
        return df.withColumn("_share", share).where(F.col("slot") % every == every - 1)

    def merge(a: State, b: State) -> State:
        fade = F.pow(F.lit(decay), b["n"])
        late = (1 - decay) * F.pow(F.lit(decay), b["n"] - 1) * b["first"] + b["rest"]
        return {"n": a["n"] + b["n"], "first": F.when(a["n"] > 0, a["first"]).otherwise(b["first"]), "rest": F.when(a["n"] > 0, a["rest"] * fade + F.when(b["n"] > 0, late).otherwise(0.0)).otherwise(b["rest"])}

    return Stat(
        tuple(keys),
        {"n": F.count("_share").cast("double"), "first": F.max("_share"), "rest": F.lit(0.0)},
        merge,
        lambda s: {"profile": F.pow(F.lit(decay), s["n"] - 1) * s["first"] + s["rest"]},
        prepare,
    )


@register_stat("extremes")
def extremes(high: str, low: str, keys: Sequence[str] = ("instrument",)) -> Stat:
    return Stat(
        tuple(keys),
        {"high": F.max(high), "low": F.min(low)},
        lambda a, b: {"high": F.greatest(a["high"], b["high"]), "low": F.least(a["low"], b["low"])},
        lambda s: {"high": s["high"], "low": s["low"], "range": s["high"] - s["low"]},
        by_merging={"high": F.max("high"), "low": F.min("low")},
    )


@register_stat("quantiles")
def quantiles(x: str, levels: Sequence[float] = (0.1, 0.5, 0.9), keys: Sequence[str] = ("horizon",), k: int = 4096) -> Stat:
    """Quantiles of x from sketches; the horizon is x's name."""
    at = lambda s, q: F.kll_sketch_get_quantile_double(s, F.lit(float(q)))
    return Stat(
        tuple(keys),
        {"sketch": F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(k))},
        lambda a, b: {"sketch": F.kll_sketch_merge_double(a["sketch"], b["sketch"])},
        lambda s: {f"q{round(100 * q):02d}": at(s["sketch"], q) for q in levels},
        lambda df: df.withColumn("horizon", F.lit(x)),
        {"sketch": F.kll_merge_agg_double("sketch")},
    )


@register_stat("regression")
def regression(y: str, xs: Sequence[str], keys: Sequence[str] = ("slot",)) -> Stat:
    """Sums of products of y and xs over rows without gaps: fits of any span of dates come from merged sums (see neutral.rolling_betas)."""
    cols = [y, *xs]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    only = lambda v: F.coalesce(F.sum(F.when(whole, v)), F.lit(0.0))
    state = {"n": F.count_if(whole).cast("double")}
    state |= {f"s{i}": only(F.col(c).cast("double")) for i, c in enumerate(cols)}
    state |= {f"s{i}_{j}": only(F.col(cols[i]).cast("double") * F.col(cols[j])) for i in range(len(cols)) for j in range(i, len(cols))}
    return Stat(tuple(keys), state, lambda a, b: {c: a[c] + b[c] for c in state}, lambda s: {c: s[c] for c in state}, by_merging={c: F.sum(c) for c in state})


def _fields(struct: Column, names: Sequence[str]) -> dict[str, Column]:
    return {n: struct[n] for n in names}


def folded(stat: Stat, states: DataFrame, time: str = "date") -> DataFrame:
    """keys and one state, of any number of states of each key, merged in order of time."""
    names = list(stat.state)
    if stat.by_merging:
        return states.groupBy(*stat.keys).agg(*[e.alias(n) for n, e in stat.by_merging.items()])
    listed = F.array_sort(F.collect_list(F.struct(time, F.struct(*names).alias("s"))), lambda a, b: F.when(a[time] < b[time], -1).when(a[time] > b[time], 1).otherwise(0))
    merged = F.aggregate(
        F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["s"]), F.get("l", F.lit(0))["s"],
        lambda a, b: F.struct(*[v.alias(n) for n, v in stat.merge(_fields(a, names), _fields(b, names)).items()]),
    )
    return states.groupBy(*stat.keys).agg(listed.alias("l")).select(*stat.keys, merged.alias("s")).select(*stat.keys, "s.*")


@dataclass
class Stats:
    """Stored states of statistics under root/<name>/day and root/<name>/upto, both by date."""

    spark: SparkSession
    root: str

    def _path(self, name: str, kind: str) -> str:
        return f"{self.root.rstrip('/')}/{name}/{kind}"

    def states(self, name: str, kind: str = "day") -> DataFrame:
        return self.spark.read.parquet(self._path(name, kind))

    def last(self, name: str):
        """The latest date up to which states are merged; None before the first."""
        path = self._path(name, "upto")
        if not exists(self.spark, path):
            return None
        return self.states(name, "upto").agg(F.max("date")).first()[0]  # read off the partitions

    def add(self, name: str, stat: Stat, rows: DataFrame) -> None:
        """Takes in the dates of `rows` that come after the last one; others are there already and are left out."""
        last = self.last(name)
        new = rows if last is None else rows.where(F.col("date") > F.lit(last))
        day = stat.prepare(new).groupBy("date", *stat.keys).agg(*[e.alias(n) for n, e in stat.state.items()])
        end = new.agg(F.max("date")).first()[0]
        if end is None:
            return
        path = self._path(name, "day")
        out = day.repartition("date").write.mode("overwrite" if exists(self.spark, path) else "append")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        made = self.states(name)
        fresh = made.where((F.col("date") <= F.lit(end)) & (F.lit(True) if last is None else F.col("date") > F.lit(last)))
        names = ["date", *stat.keys, *stat.state]
        if last is not None:
            before = self.states(name, "upto").where(F.col("date") == F.lit(last))
            fresh = before.select(*names).unionByName(fresh.select(*names))
        merged = folded(stat, fresh.select(*names)).withColumn("date", F.lit(end))
        # Written after the days, so that a run that fails between the two is simply made again.
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(self._path(name, "upto"))

    def value(self, name: str, stat: Stat, until=None) -> DataFrame:
        """keys and what `finish` makes of the states merged up to the last date (or a date that was the last of an addition)."""
        at = self.last(name) if until is None else until
        found = self.states(name, "upto").where(F.col("date") == F.lit(at))
        return found.select(*stat.keys, *[v.alias(n) for n, v in stat.finish(_fields_of(stat)).items()])

    def window(self, name: str, stat: Stat, first, last) -> DataFrame:
        """keys and the value over the dates from first to last: their states merged, no rows read."""
        span = self.states(name).where(F.col("date").between(F.lit(first), F.lit(last)))
        merged = folded(stat, span.select("date", *stat.keys, *stat.state))
        return merged.select(*stat.keys, *[v.alias(n) for n, v in stat.finish(_fields_of(stat)).items()])

    def forget(self, name: str) -> None:
        remove(self.spark, f"{self.root.rstrip('/')}/{name}")


def _fields_of(stat: Stat) -> dict[str, Column]:
    return {n: F.col(n) for n in stat.state}
