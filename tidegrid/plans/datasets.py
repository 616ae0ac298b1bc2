"""Training items and model inference over factors: what a day's features, targets and filters are, and what is drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.models import mlp
from tidegrid.operators import panel
from tidegrid.plans.factors import FactorDef, compile_factors

DATASETS: dict[str, Callable[..., DataFrame]] = {}
COLLATES: dict[str, Callable[..., DataFrame]] = {}
KEYS = ("date", "instrument", "slot")


def _register(store: dict[str, Callable[..., DataFrame]], name: str):
    def put(f):
        if name in store:
            raise ValueError(f"{name} is registered already")
        store[name] = f
        return f

    return put


def register_dataset(name: str):
    return _register(DATASETS, name)


def register_collate(name: str):
    return _register(COLLATES, name)


@register_dataset("intraday_cs")
def intraday_items(daily: DataFrame, intraday: DataFrame, features: Sequence[FactorDef], targets: Sequence[FactorDef], filters: Sequence[FactorDef], slots: int) -> DataFrame:
    """date, instrument, slot, the features, the targets and `selector`: all filters over zero.

    The three lists are one plan, so their history and future columns share one exchange by
    instrument, and all dates are made together.
    """
    every = {d.name: d for d in (*features, *targets, *filters)}
    made = compile_factors(list(every.values()), daily, intraday, slots)
    named = dict.fromkeys(d.name for d in (*features, *targets))
    return made.select(*KEYS, *named, F.coalesce(panel.all_positive([d.name for d in filters]), F.lit(False)).alias("selector"))


@register_collate("sequence")
def whole_sequences(items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row of the items; a missing value in the columns fails the query."""
    return panel.without_gaps(items, columns)


@register_collate("sample")
def one_slot_each(items: DataFrame, seed: int, period: tuple[int, int]) -> DataFrame:
    """One slot drawn for each instrument and day; rows that the selector refuses are dropped, not drawn anew."""
    return panel.one_random_slot(items, seed, ("date", "instrument"), "slot", period, selector=F.col("selector"))


def infer(defs: Sequence[FactorDef], weights: Mapping, daily: DataFrame, intraday: DataFrame, slots: int, model: str = "mlp", outputs: Sequence[int] | None = None) -> DataFrame:
    """Predictions from raw panels: the factors of a list, in its order, go through a model; position is the slot's place in 240 minutes."""
    made = compile_factors(defs, daily, intraday, slots)
    rows = made.select(*KEYS, F.array(*[d.name for d in defs]).alias("_x"), F.floor(F.col("slot") / float(slots) * 240).alias("_position"))
    return mlp.predict(rows, "_x", weights, KEYS, model, outputs, "_position")
