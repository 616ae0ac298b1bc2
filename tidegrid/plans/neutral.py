"""Neutralisation of stored variables, for the dates that are not there yet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.xsection import neutralize, solved
from tidegrid.plans.stats import Stat
from tidegrid.sources.store import PanelStore, Variable


@dataclass(frozen=True)
class Target:
    """A column to neutralise and the name of its residual; share: how much of the fit is taken off."""

    column: str
    name: str
    intercept: bool = True
    share: float = 1.0
    nonpositive: bool = False


def neutralize_missing(store: PanelStore, regressors: Sequence[Variable], dependents: Sequence[Variable], output: Variable, targets: Sequence[Target], keys: Sequence[str] = ("date", "instrument", "slot"), by: Sequence[str] = ("date", "slot"), least: int = 500) -> DataFrame:
    """Residuals of the targets on all fields of the regressors, saved for dates that inputs have and the output lacks.

    All those dates are one job, which reads their partitions only. Returns date and the mean leading beta of each target.
    """
    keys, by = list(keys), list(by)
    todo = [r.date for r in store.todo([*regressors, *dependents], output).collect()]  # as many as trading days
    read = [store.load(v).where(F.col("date").isin(todo)) for v in (*regressors, *dependents)]
    rows = reduce(lambda a, b: a.join(b, keys, "full"), read)
    xs = list(dict.fromkeys(f for v in regressors for f in v.fields))
    made = [(t, neutralize(rows, t.column, xs, by, least, t.intercept, t.nonpositive, t.share)) for t in targets]
    residuals = [m.select(*keys, F.col("residual").alias(t.name)) for t, m in made]
    out = reduce(lambda a, b: a.join(b, keys, "full"), residuals)
    if todo:
        store.save(output, out)
    means = [m.groupBy("date").agg(F.avg(f"beta_{xs[0]}").alias(t.name)) for t, m in made]
    return reduce(lambda a, b: a.join(b, "date", "full"), means)


def rolling_betas(states: DataFrame, stat: Stat, y: str, xs: Sequence[str], days: int, least: int = 20, intercept: bool = True) -> DataFrame:
    """keys, date, n, intercept and beta_x of fits of y on xs over the last `days` stored dates of each date, from stored states of the regression statistic.

    The states of a window are added up; no row is read again, whatever the window.
    """
    cols = [y, *xs]
    over = Window.partitionBy(*stat.keys).orderBy("date").rowsBetween(-(days - 1), 0) if stat.keys else Window.orderBy("date").rowsBetween(-(days - 1), 0)
    sums = states.select(*stat.keys, "date", *[F.sum(c).over(over).alias(c) for c in stat.state])
    mean = [F.try_divide(f"s{i}", "n") for i in range(len(cols))]
    moments = [m.alias(f"_m{i}") for i, m in enumerate(mean)]
    moments += [(F.try_divide(f"s{i}_{j}", "n") - mean[i] * mean[j]).alias(f"_s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    ready = sums.where(F.col("n") >= least).select(*stat.keys, "date", F.col("n").cast("long").alias("_n"), *moments)
    fit = solved(ready, [*stat.keys, "date"], len(xs), intercept, False)
    return fit.select(*stat.keys, "date", F.col("_n").alias("n"), F.col("_base").alias("intercept"), *[F.get("_beta", F.lit(i)).alias(f"beta_{x}") for i, x in enumerate(xs)])
