"""Factors and the compiler that turns a list of them into one lazy frame.

A factor is a function from a `Plan` to a Column. It asks the plan for what it needs, by meaning, and
gets the name of a column back; equal needs are one column. The compiler then lays out

    dense daily grid -> history (and future) columns: one exchange by instrument
    -> equi-join with the dense intraday grid on (instrument, date); over spans bars go to their days before the history is computed
    -> for each dependency level: running columns, then the factors: one exchange by (instrument, date)
    -> cross-sectional ranks: one exchange by (date, slot), over spans one of days by date
    -> shift, scale, clip.

Prices are adjusted as of each day by factoring: adjusted_x of day t seen from day D is
x_t / factor_t * factor_D, and factor_D is constant within D's window, so every window runs on
x / factor and is multiplied once. All days fit one window pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import cents, clip, larger, ln, ln1p, ratio, smaller
from tidegrid.operators import moments, windows
from tidegrid.operators.panel import partitions
from tidegrid.operators.recurrence import Recurrence
from tidegrid.operators.spans import AT, BARS, TO, Spans, by_bar, by_day, in_turn, laid_out, own, with_bars
from tidegrid.operators.xsection import ranked_columns, with_percentiles


@dataclass(frozen=True)
class FactorDef:
    """kind: a registered factor; daily, intraday, future: input fields; cache: raw columns of earlier factors."""

    kind: str
    window: int = 0
    daily: tuple[str, ...] = ()
    intraday: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    cache: tuple[str, ...] = ()
    shift: float = 0.0
    scale: float = 1.0
    lower: float = -5.0
    upper: float = 5.0
    window2: int = 0
    threshold: float = 0.8
    prefix: str = ""

    @property
    def name(self) -> str:
        base = f"{self.prefix}{self.kind}" if self.kind not in ("abs", "id", "rank_targets") else f"{self.prefix}{self.kind}_{(self.cache or self.intraday)[0]}"
        return f"{base}_{self.window}" if self.window or self.kind in ("future_day_targets", "inter_day_targets") else base


Builder = Callable[["Plan", FactorDef], Column]
REGISTRY: dict[str, tuple[Builder, dict[str, int]]] = {}


def register_factor(kind: str, **arity: int) -> Callable[[Builder], Builder]:
    """Adds a factor; arity: how many fields it takes of daily, intraday, future, cache (checked when a plan is built)."""

    def put(build: Builder) -> Builder:
        if kind in REGISTRY:
            raise ValueError(f"factor {kind} is registered already")
        REGISTRY[kind] = build, arity
        return build

    return put


_FLOWS = ("volume", "turnover", "amount")


class Plan:
    """What a list of factors needs, collected while they are built."""

    def __init__(self, defs: Sequence[FactorDef], slots: int, factor: str = "factor", flows: Sequence[str] = ()) -> None:
        self.slots, self.factor = slots, factor
        self.history: dict[str, Column] = {}
        self.sums: dict[str, tuple[Column, int]] = {}
        self.deeper: dict[str, Column] = {}
        self.levels: list[dict] = []
        self.names = {d.name for d in defs}
        self.level_of: dict[str, int] = {}
        self._level = 0
        # Over spans: the columns that are not the same on all slots of a span, and why (see Recurrence.over_spans; moving: any other way).
        self.nature: dict[str, str] = {"slot": "moving", **dict.fromkeys(flows, "flow")}
        self.source: dict[str, str] = {}
        self.reads: set[str] = set()
        # History columns that the factor needs, and for each factor all that it reads.
        self.needs: set[str] = set()
        self.uses: dict[str, set[str]] = {}
        self.over_spans = True

    # Daily side ---------------------------------------------------------------

    def base(self, field: str) -> tuple[Column, int]:
        """The field as stored, and the power of the day's factor that turns it into the field as of that day."""
        if not field.startswith("adjusted_"):
            return F.col(field), 0
        raw = field.removeprefix("adjusted_")
        if raw in _FLOWS:
            return F.col(raw) * F.col(self.factor), -1
        return F.try_divide(F.col(raw), F.col(self.factor)), 1

    def _put(self, store: dict[str, Column], name: str, value: Column) -> Column:
        store.setdefault(name, value)
        self.needs.add(name)
        return F.col(name)

    def _sum(self, name: str, term: Column, w: int) -> Column:
        self.sums.setdefault(name, (term, w))
        self.needs.add(name)
        return F.col(name)

    def daily(self, what: str, field: str, value: Callable[[Column], Column]) -> Column:
        """A history (or future) column of one field, homogeneous in it."""
        x, power = self.base(field)
        out = value(x)
        out = out * F.col(self.factor) if power == 1 else F.try_divide(out, F.col(self.factor)) if power == -1 else out
        return self._put(self.history, f"_h_{what}_{field}", out)

    def power_sum(self, field: str, power: int, w: int) -> Column:
        """Sum of x^power over the w days before; power 0 counts."""
        x, degree = self.base(field)
        if w < 1:
            return F.lit(0.0)
        term = F.when(x.isNotNull(), F.lit(1.0)) if power == 0 else x
        for _ in range(power - 1):
            term = term * x
        name = f"_s{power}_{field}_{w}"
        out = self._sum(name, term, w)
        if degree and power:
            scale = F.pow(self.factor, F.lit(float(power)))
            out = out * scale if degree == 1 else F.try_divide(out, scale)
        return out

    def product_sum(self, a: str, b: str, w: int, f: Callable[[Column], Column] = lambda x: x, tag: str = "") -> tuple[Column, Column]:
        """Sum of f(a) b over the w days before and the number of days that have both."""
        x, _ = self.base(a)
        y, degree = self.base(b)
        if w < 1:
            return F.lit(0.0), F.lit(0.0)
        name = f"_p{tag}_{a}_{b}_{w}"
        out = self._sum(name, f(x) * y, w)
        n = self._sum(f"{name}_n", F.when(x.isNotNull() & y.isNotNull(), F.lit(1.0)), w)
        return (F.try_divide(out, F.col(self.factor)) if degree == -1 else out * F.col(self.factor) if degree == 1 else out), n

    def pair_sum(self, x: str, y: str, of: str, power: int, w: int) -> Column:
        """Sum of of^power over the days of the w before that have both x and y."""
        a, b = self.base(x)[0], self.base(y)[0]
        v, degree = self.base(of)
        term = F.when(a.isNotNull() & b.isNotNull(), v if power == 1 else v * v)
        name = f"_q{power}_{x}_{y}_{of}_{w}"
        if w < 1:
            return F.lit(0.0)
        out = self._sum(name, term, w)
        scale = F.pow(self.factor, F.lit(float(power)))
        return F.try_divide(out, scale) if degree == -1 else out * scale if degree == 1 else out

    # Intraday side ------------------------------------------------------------

    def now(self, field: str) -> Column:
        """The field's value in the slot: an intraday field, or an earlier factor's raw value."""
        self.reads.add(field)
        return F.col(field)

    def fraction(self) -> Column:
        self.reads.add("slot")
        return (F.col("slot") + 1) / F.lit(float(self.slots))

    @property
    def moves(self) -> bool:
        """Whether the factor has read anything, so far, that is not the same on all slots of a span."""
        return not self.reads.isdisjoint(self.nature)

    def _sort_out(self, name: str, value: Column | Recurrence, of: str | None) -> None:
        nature = self.nature.get(of, "still")
        if isinstance(value, Recurrence):
            made = {"change still": "step", "sum flow": "moving", "count step": "moving", "count flow": "moving", "spread flow": "moving"}.get(f"{value.kind} {nature}")
            if of is None or not made and f"{value.kind} {nature}" not in ("first still", "high still", "low still", "sum step"):
                self.over_spans = False
        else:
            made = "flow" if nature == "flow" else "moving" if self.moves else None
        if made:
            self.nature[name] = made
        if of:
            self.source[name] = of

    def running(self, depth: int, name: str, value: Column | Recurrence, of: str | None = None) -> Column:
        """A column over the running day (or a plain one), computed before this level's factors; deeper ones may use shallower ones.

        of: the one column that a recurrence's input is made of, zero where that is zero; of a plain column likewise.
        """
        while len(self.levels) <= self._level:
            self.levels.append({"running": {}, "factors": {}})
        stage = self.levels[self._level]["running"].setdefault(depth, {})
        seen = any(name in s for lv in self.levels for s in lv["running"].values())
        if not seen:
            stage[name] = value
            self._sort_out(name, value, of)
        self.reads.add(name)
        return F.col(name)

    def part(self, of: str, step: int = 0) -> moments.Keep:
        """Keeps parts of a formula as columns, in one projection for each step of all formulas of a level.

        An expression is a tree: a part that is used ten times would be planned and compiled ten times.
        """
        return lambda name, value: self.running(10 + step, f"_k{step}_{of}_{name}", value)

    def change(self, field: str) -> Column:
        return self.running(0, f"_d_{field}", Recurrence("change", F.col(field)), field)

    def opening(self, field: str) -> Column:
        return self.running(0, f"_o_{field}", Recurrence("first", F.col(field)), field)

    def total(self, field: str) -> Column:
        return self.running(0, f"_t_{field}", Recurrence("sum", F.coalesce(F.col(field), F.lit(0.0))), field)

    def running_moments(self, name: str, x: Column) -> tuple[Column, Column, Column, Column]:
        """Count and sums of powers of the column _name."""
        out = [self.running(1, f"_n_{name}", Recurrence("count", x), f"_{name}")]
        for k in (1, 2, 3):
            term = x if k == 1 else x * x if k == 2 else x * x * x
            out.append(self.running(1, f"_r{k}_{name}", Recurrence("sum", term), f"_{name}"))
        return tuple(out)


# History factors -----------------------------------------------------------------


def _per_root(x: Column, w: int) -> Column:
    return x / F.sqrt(F.lit(float(w)))


@register_factor("price_dev_from_ma", daily=1, intraday=1)
def _dev_ma(plan: Plan, d: FactorDef) -> Column:
    mean = F.try_divide(plan.power_sum(d.daily[0], 1, d.window), plan.power_sum(d.daily[0], 0, d.window))
    return _per_root(ln(plan.now(d.intraday[0])) - ln(mean), d.window)


def _vwap(plan: Plan, price: str, volume: str, w: int) -> Column:
    traded, _ = plan.product_sum(price, volume, w)
    volumes = plan.power_sum(volume, 1, w)
    mean = F.try_divide(plan.power_sum(price, 1, w), plan.power_sum(price, 0, w))
    return F.when(volumes == 0, mean).otherwise(traded * (F.col(plan.factor) if price.startswith("adjusted_") else 1.0) / (volumes + 1e-6))


@register_factor("price_dev_from_vwap", daily=2, intraday=1)
def _dev_vwap(plan: Plan, d: FactorDef) -> Column:
    return _per_root(ln(plan.now(d.intraday[0])) - ln(_vwap(plan, *d.daily, d.window)), d.window)


@register_factor("price_dev_from_yest_vwap", daily=1, intraday=1)
def _dev_yesterday(plan: Plan, d: FactorDef) -> Column:
    return ln(plan.now(d.intraday[0])) - ln(plan.daily("yest", d.daily[0], windows.yesterday))


@register_factor("price_position", daily=2, intraday=1)
def _position(plan: Plan, d: FactorDef) -> Column:
    p = plan.now(d.intraday[0])
    hi = larger(plan.daily(f"high{d.window}", d.daily[0], lambda x: windows.high(x, d.window)), p)
    lo = smaller(plan.daily(f"low{d.window}", d.daily[1], lambda x: windows.low(x, d.window)), p)
    return F.try_divide(p - lo, hi - lo)


@register_factor("daily_mom", daily=1, intraday=1)
def _momentum(plan: Plan, d: FactorDef) -> Column:
    then = plan.daily(f"lag{d.window}", d.daily[0], lambda x: windows.lag_filled(x, d.window))
    return _per_root(ln(plan.now(d.intraday[0])) - ln(then), d.window)


@register_factor("daily_mom_sum", daily=1, intraday=1)
def _momentum_sum(plan: Plan, d: FactorDef) -> Column:
    return _per_root(plan.now(d.intraday[0]) + plan.power_sum(d.daily[0], 1, d.window - 1), d.window)


@register_factor("intraday_mom", intraday=1)
def _intraday_momentum(plan: Plan, d: FactorDef) -> Column:
    f = d.intraday[0]
    return _per_root(ln(plan.now(f)) - ln(plan.opening(f)), max(d.window, 1))


def _today(plan: Plan, d: FactorDef) -> Column:
    return plan.now((d.cache or d.intraday)[0])


@register_factor("daily_volatility", daily=1)
def _volatility(plan: Plan, d: FactorDef) -> Column:
    n, _, square = _with_today(plan, d, 2)
    return F.sqrt(square / n)


@register_factor("daily_volvol", daily=1)
def _volvol(plan: Plan, d: FactorDef) -> Column:
    """Spread of the last window2 root mean squares over `window` days, today's included; NULL without enough history."""
    w, w2, f = d.window, d.window2, d.daily[0]
    x, _ = plan.base(f)
    vol = plan._put(plan.history, f"_v_{f}_{w}", F.sqrt(windows.rolling_moment(x, 2, w)))
    frame = windows.before(w2 - 1)
    enough = F.count(vol).over(frame) >= w2 - 1
    s1 = plan._put(plan.deeper, f"_vv1_{f}_{w}_{w2}", F.when(enough, F.sum(vol).over(frame)))
    s2 = plan._put(plan.deeper, f"_vv2_{f}_{w}_{w2}", F.when(enough, F.sum(vol * vol).over(frame)))
    r = _today(plan, d)
    keep = plan.part(f"{d.name}_{f}")
    v0 = keep("now", F.sqrt((plan.power_sum(f, 2, w - 1) + r * r) / w))
    mean = plan.part(d.name, 1)("mean", (s1 + v0) / w2)
    spread = plan.part(d.name, 2)("spread", (s2 + v0 * v0) / w2 - mean * mean)
    return F.when(spread.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0))))


def _steps(plan: Plan, d: FactorDef, first: str = "") -> moments.Keep:
    """Parts of a factor's formula: the one called `first` a step before the others."""
    return lambda name, value: plan.part(d.name, 1 if name == first else 2)(name, value)


def _with_today(plan: Plan, d: FactorDef, powers: int) -> list[Column]:
    r, w = _today(plan, d), d.window - 1
    keep = plan.part(f"{d.daily[0]}_{(d.cache or d.intraday)[0]}_{d.window}")
    out, term = [keep("n", plan.power_sum(d.daily[0], 0, w) + 1)], F.lit(1.0)
    for k in range(1, powers + 1):
        term = term * r
        out.append(keep(f"s{k}", plan.power_sum(d.daily[0], k, w) + term))
    return out


@register_factor("daily_skewness", daily=1)
def _skewness(plan: Plan, d: FactorDef) -> Column:
    return moments.skewness(*_with_today(plan, d, 3), keep=_steps(plan, d, "mean"))


@register_factor("daily_kurtosis", daily=1)
def _kurtosis(plan: Plan, d: FactorDef) -> Column:
    n, *sums = _with_today(plan, d, 4)
    return F.when(n >= d.window, moments.excess_kurtosis(F.lit(float(d.window)), *sums, keep=_steps(plan, d, "mean")))


@register_factor("volume_ratio", daily=1, intraday=1)
def _volume_ratio(plan: Plan, d: FactorDef) -> Column:
    mean = F.try_divide(plan.power_sum(d.daily[0], 1, d.window), plan.power_sum(d.daily[0], 0, d.window))
    return ln((plan.total(d.intraday[0]) + 1) / plan.fraction()) - ln(mean)


@register_factor("rv_corr", daily=2)
def _return_volume(plan: Plan, d: FactorDef) -> Column:
    r, v, w = *d.daily, d.window - 1
    now_r = _today(plan, d)
    now_v = plan.part(d.intraday[-1])("rate", plan.total(d.intraday[-1]) / plan.fraction())
    sxy, n = plan.product_sum(r, v, w)
    part = lambda of, k: plan.pair_sum(r, v, of, k, w)
    keep = plan.part(d.name, 1)
    sums = {"n": n + 1, "sx": part(r, 1) + now_r, "sy": part(v, 1) + now_v, "sxx": part(r, 2) + now_r * now_r, "syy": part(v, 2) + now_v * now_v, "sxy": sxy + now_r * now_v}
    return moments.correlation(*[keep(k, x) for k, x in sums.items()], max(2, d.window // 2), keep=_steps(plan, d))


@register_factor("daily_on_balance_volume_ratio", daily=2)
def _on_balance(plan: Plan, d: FactorDef) -> Column:
    r, v, w = *d.daily, d.window
    signed, _ = plan.product_sum(r, v, w - 1, F.signum, "sgn")
    mean = F.try_divide(plan.power_sum(v, 1, w), plan.power_sum(v, 0, w))
    now = plan.total(d.intraday[-1]) * F.signum(_today(plan, d)) / plan.fraction()
    return F.try_divide(signed / w + now / w, mean + 1)


@register_factor("daily_recent_vacancy", daily=1)
def _vacancy(plan: Plan, d: FactorDef) -> Column:
    return (plan.power_sum(d.daily[0], 0, d.window) / d.window > d.threshold).cast("double")


# The running day ---------------------------------------------------------------------


@register_factor("today_amount_ratio", intraday=2)
def _amount_ratio(plan: Plan, d: FactorDef) -> Column:
    return plan.total(d.intraday[0]) / (plan.total(d.intraday[1]) + 1)


@register_factor("today_mom")
def _today_momentum(plan: Plan, d: FactorDef) -> Column:
    f = (d.cache or d.intraday)[0]
    return plan.now(f) - plan.opening(f)


@register_factor("today_volatility")
def _today_volatility(plan: Plan, d: FactorDef) -> Column:
    f = (d.cache or d.intraday)[0]
    v = plan.change(f)
    s = plan.running(1, f"_r2_d_{f}", Recurrence("sum", v * v), f"_d_{f}")
    n = plan.running(1, f"_n_d_{f}", Recurrence("count", v), f"_d_{f}")
    return F.when(n > 1, F.sqrt(F.try_divide(s, n - 1))).otherwise(F.sqrt(s) * 0.5)


@register_factor("today_skewness")
def _today_skewness(plan: Plan, d: FactorDef) -> Column:
    f = (d.cache or d.intraday)[0]
    v = plan.change(f)
    return F.when(v.isNotNull(), moments.adjusted_skewness(*plan.running_moments(f"d_{f}", v), keep=_steps(plan, d, "mean")))


@register_factor("today_std", intraday=1)
def _today_std(plan: Plan, d: FactorDef) -> Column:
    f = d.intraday[0]
    return plan.running(0, f"_sd_{f}", Recurrence("spread", ln1p(f)), f)


@register_factor("today_log_skewness", intraday=1)
def _today_log_skewness(plan: Plan, d: FactorDef) -> Column:
    f = d.intraday[0]
    x = plan.running(0, f"_l_{f}", ln1p(f), f)
    return F.when(x.isNotNull(), moments.adjusted_skewness(*plan.running_moments(f"l_{f}", x), keep=_steps(plan, d, "mean")))


@register_factor("today_position", intraday=3)
def _today_position(plan: Plan, d: FactorDef) -> Column:
    p, h, l = (plan.now(f) for f in d.intraday)  # noqa: E741
    hi = plan.running(0, f"_hi_{d.intraday[1]}", Recurrence("high", F.col(d.intraday[1])), d.intraday[1])
    lo = plan.running(0, f"_lo_{d.intraday[2]}", Recurrence("low", F.col(d.intraday[2])), d.intraday[2])
    return F.when((p == 0) | F.coalesce(hi - lo, F.lit(0.0)).isin(0.0), 0.5).otherwise((p - lo) / F.nullif(hi - lo, F.lit(0.0)))


@register_factor("id")
def _identity(plan: Plan, d: FactorDef) -> Column:
    return plan.now((d.cache or d.intraday)[0])


@register_factor("abs")
def _absolute(plan: Plan, d: FactorDef) -> Column:
    return F.abs(plan.now((d.cache or d.intraday)[0]))


@register_factor("div")
def _quotient(plan: Plan, d: FactorDef) -> Column:
    a, b = (*d.cache, *d.intraday)
    return ratio(plan.now(a), plan.now(b))


def _limit(plan: Plan, d: FactorDef, up: bool) -> Column:
    """1 where a price is a 5, 10 or 20 % limit away from yesterday's close and one side of the book is empty."""
    price, ask, bid = (plan.now(f) for f in d.intraday)
    move = cents(F.try_divide(price, plan.daily("yest", d.daily[0], windows.yesterday)) - 1)
    at = move.isin(*[(x if up else -x) for x in (0.05, 0.1, 0.2)])
    empty = (ask == 0) & (bid > 0) if up else (bid == 0) & (ask > 0)
    return F.coalesce(at & empty, F.lit(False)).cast("double")


@register_factor("is_up_limit", daily=1, intraday=3)
def _up_limit(plan: Plan, d: FactorDef) -> Column:
    return _limit(plan, d, True)


@register_factor("is_down_limit", daily=1, intraday=3)
def _down_limit(plan: Plan, d: FactorDef) -> Column:
    return _limit(plan, d, False)


@register_factor("is_tradable", daily=1, intraday=3)
def _tradable(plan: Plan, d: FactorDef) -> Column:
    return 1 - _limit(plan, d, True)


# Targets ---------------------------------------------------------------------------------


def _or_mid(price: Column, mid: Column) -> Column:
    return F.when(price == 0, mid).otherwise(price)


@register_factor("future_day_targets", future=1)
def _future_day(plan: Plan, d: FactorDef) -> Column:
    ahead = plan.daily(f"fut{d.window}", d.future[0], lambda x: windows.future(x, d.window))
    buy, mid = plan.now(d.intraday[0]), plan.now(d.intraday[-1])
    return ln(ahead) - ln(_or_mid(buy, mid))


@register_factor("inter_day_targets", future=1)
def _inter_day(plan: Plan, d: FactorDef) -> Column:
    ahead = plan.daily(f"fut{d.window}", d.future[0], lambda x: windows.future(x, d.window))
    f = d.intraday[-1]
    close = plan.running(0, f"_c_{f}", Recurrence("whole", F.last(f).over(windows.today().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return ln(ahead) - ln(close)


@register_factor("future_day_range_targets", future=2)
def _future_range(plan: Plan, d: FactorDef) -> Column:
    hi = plan.daily(f"fhi{d.window}", d.future[0], lambda x: windows.future_high(x, d.window))
    lo = plan.daily(f"flo{d.window}", d.future[1], lambda x: windows.future_low(x, d.window))
    return ln(hi) - ln(lo)


@register_factor("future_day_up_range_targets", future=1, intraday=1)
def _future_up(plan: Plan, d: FactorDef) -> Column:
    return ln(plan.daily(f"fhi{d.window}", d.future[0], lambda x: windows.future_high(x, d.window))) - ln(plan.now(d.intraday[0]))


@register_factor("future_day_down_range_targets", future=1, intraday=1)
def _future_down(plan: Plan, d: FactorDef) -> Column:
    return ln(plan.daily(f"flo{d.window}", d.future[0], lambda x: windows.future_low(x, d.window))) - ln(plan.now(d.intraday[0]))


@register_factor("today_targets", intraday=3)
def _today_target(plan: Plan, d: FactorDef) -> Column:
    buy, sell, mid = d.intraday
    price = plan.running(0, f"_sell_{sell}_{mid}", _or_mid(F.col(sell), F.col(mid)))
    end = F.last(price).over(windows.today().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    then = plan.running(1, f"_to{d.window}_{sell}_{mid}", Recurrence("whole", F.coalesce(F.lead(price, d.window).over(windows.today()), end)))
    return ln(then) - ln(_or_mid(plan.now(buy), plan.now(mid)))


@register_factor("rank_targets", cache=1)
def _rank_target(plan: Plan, d: FactorDef) -> Column:
    """Filled in by the compiler: ranks need the whole cross-section."""
    plan.over_spans = False
    return F.lit(None).cast("double")


# The compiler --------------------------------------------------------------------------------


def levels(defs: Sequence[FactorDef], fields: Sequence[str]) -> dict[str, int]:
    """The dependency level of each factor; a missing or circular input is an error."""
    by_name = {d.name: d for d in defs}
    if len(by_name) < len(defs):
        raise ValueError("two factors of one name")
    found: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> int:
        if name in path:
            raise ValueError(f"circular factors: {' -> '.join((*path, name))}")
        if name not in found:
            inputs = by_name[name].cache
            for i in inputs:
                if i not in by_name and i not in fields:
                    raise ValueError(f"{name} needs {i}, which no factor makes")
            found[name] = 1 + max((visit(i, (*path, name)) for i in inputs if i in by_name), default=-1)
        return found[name]

    for d in defs:
        visit(d.name, ())
    return found


@dataclass
class OverSpans:
    """How a list is laid out over a day's bars: what windows over the running day are made of, what follows for whole spans, and by slot.

    before, after: columns that hold for whole spans, in steps: what windows make or read, and the rest. slots: the steps that the others take once
    the slots are laid out. kept: the columns that `after` and `slots` read. windowed: all that windows read, history columns among them.
    """

    before: list[dict[str, Column]]
    after: list[dict[str, Column]]
    slots: list[dict[str, Column]]
    kept: set[str]
    flows: list[str]
    windowed: set[str]


def _stepwise(frame: DataFrame, steps: Sequence[dict[str, Column]]) -> DataFrame:
    for made in steps:
        frame = frame.withColumns(made) if made else frame
    return frame


@dataclass
class Compiled:
    """A list of factors laid out by level over its plan."""

    defs: Sequence[FactorDef]
    plan: Plan
    built: dict[str, Column]
    level_of: dict[str, int]

    KEYS = ("date", "instrument", "slot")

    def history(self, daily: DataFrame, only: Collection[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """date, instrument, the day's factor, the history (and future) columns (or only those named) and carried ones: one exchange by instrument."""
        plan = self.plan
        history, sums, deeper = ({n: v for n, v in x.items() if only is None or n in only} for x in (plan.history, plan.sums, plan.deeper))
        side = daily.withColumns(history) if history else daily
        side = windows.with_history_sums(side, sums) if sums else side
        side = side.withColumns(deeper) if deeper else side
        return side.select("date", "instrument", plan.factor, *history, *sums, *deeper, *carry)

    @property
    def reads_history(self) -> bool:
        return bool(self.plan.history or self.plan.sums or self.plan.deeper)

    def inputs(self, intraday: DataFrame | Spans) -> list[str]:
        return list(dict.fromkeys(f for d in self.defs for f in (*d.intraday, *d.cache) if f in intraday.columns))

    def stages(self) -> list[tuple[list[dict[str, Column | Recurrence]], list[FactorDef]]]:
        """For each level its running columns by depth, and its factors."""
        out = []
        for n in range(max(self.level_of.values(), default=-1) + 1):
            running = self.plan.levels[n]["running"] if n < len(self.plan.levels) else {}
            out.append(([running[k] for k in sorted(running)], [d for d in self.defs if self.level_of[d.name] == n]))
        return out

    def of_recurrences(self) -> set[str]:
        """The running-day columns that windows make, and all that they are made of."""
        found: set[str] = set()
        ahead = [n for running, _ in self.stages() for stage in running for n, v in stage.items() if isinstance(v, Recurrence)]
        while ahead:
            n = ahead.pop()
            if n not in found:
                found.add(n)
                ahead += [self.plan.source[n]] if n in self.plan.source else self.plan.uses.get(n, ())
        return found

    def over_spans(self) -> OverSpans:
        plan, windowed = self.plan, self.of_recurrences()
        first: dict[str, Column] = {}
        before, after, steps, kept = [], [], [first], {"slot", AT, TO, *(c for d in self.defs for c in ([d.name] if d.name in windowed else plan.uses[d.name]))}
        for running, here in self.stages():
            for stage in running:
                early, made, later = {}, {}, {}
                for n, v in stage.items():
                    if isinstance(v, Recurrence):
                        of = plan.source[n]
                        columns, value = v.over_spans(n, plan.nature.get(of, "still"), plan.source.get(of, of))
                        early |= columns
                        if value is not None:
                            first[n] = value
                            kept |= {*columns, of, plan.source.get(of, of)}
                    elif plan.nature.get(n) == "moving":
                        later[n] = v
                    else:
                        (early if n in windowed else made)[n] = v
                        if n in plan.nature:
                            first[n] = own(n)
                before.append(early)
                after.append(made)
                steps.append(later)
            still = {d.name: self.built[d.name] for d in here if d.name not in plan.nature}
            before.append({n: v for n, v in still.items() if n in windowed})
            after.append({n: v for n, v in still.items() if n not in windowed})
            steps.append({d.name: self.built[d.name] for d in here if d.name in plan.nature})
        return OverSpans(before, after, steps, kept, [n for n, nature in plan.nature.items() if nature == "flow"], windowed)

    @staticmethod
    def clipped(d: FactorDef) -> Column:
        return clip((F.col(d.name) - d.shift) * d.scale, d.lower, d.upper)

    def finished(self, frame: DataFrame, ranks: bool, raw: bool, keep: Sequence[str] = (), in_order: bool = False) -> DataFrame:
        """Keys, kept columns and factors, ranked where asked for, shifted, scaled and clipped. in_order: a cross-section's rows follow each other already."""
        keys = [*self.KEYS, *keep]
        early = {} if ranks or raw else {d.name: f"_f_{d.name}" for d in self.defs if f"_f_{d.name}" in frame.columns}
        frame = frame.select(*keys, *[early.get(d.name, d.name) for d in self.defs])
        if ranks:
            frame = ranked_columns(frame, [d.name for d in self.defs], ["date", "slot"], in_order=in_order)
        if raw:
            return frame
        done = [(F.col(early[d.name]) if d.name in early else self.clipped(d)).alias(d.name) for d in self.defs]
        return frame.select(*keys, *done, *frame.columns[len(keys) + len(self.defs) :])


def compiled(defs: Sequence[FactorDef], fields: Sequence[str], slots: int, flows: Sequence[str] = ()) -> Compiled:
    """The plan of a list of factors; fields: the intraday columns there are; flows: those that are zero on slots without a bar."""
    for d in defs:
        if d.kind not in REGISTRY:
            raise ValueError(f"no factor {d.kind}")
        for source, n in REGISTRY[d.kind][1].items():
            if len(getattr(d, source)) < n:
                raise ValueError(f"{d.kind} takes {n} {source} fields, not {len(getattr(d, source))}")
    level_of = levels(defs, fields)
    plan = Plan(defs, slots, flows=flows)
    built: dict[str, Column] = {}
    for d in sorted(defs, key=lambda d: level_of[d.name]):
        plan._level, plan.reads, plan.needs = level_of[d.name], set(), set()
        built[d.name] = REGISTRY[d.kind][0](plan, d)
        plan.uses[d.name] = plan.reads | plan.needs
        if plan.moves:
            plan.nature[d.name] = "moving"
    return Compiled(defs, plan, built, level_of)


def ranked_targets(frame: DataFrame, defs: Sequence[FactorDef]) -> DataFrame:
    """The ranks of a level's targets, after one exchange by cross-section."""
    return with_percentiles(frame, {d.name: d.cache[0] for d in defs}, ["date", "slot"], 2000, 3.5, sample_std=True) if defs else frame


def compile_factors(defs: Sequence[FactorDef], daily: DataFrame, intraday: DataFrame | Spans, slots: int, ranks: bool = False, raw: bool = False) -> DataFrame:
    """date, instrument, slot and a column for each factor.

    daily: the dense daily grid with `factor`; intraday: the dense intraday grid, or the spans behind it. Only the fields that
    the factors name are carried. raw: without shift, scale and clip. ranks: also rank_<factor>.
    The join of daily columns is left to the optimizer, which broadcasts only sides it knows to be small.
    Over spans there is none: a day's bars ride along as an array in the daily row while its history is computed, so that no history crosses an exchange. Every window runs over bars, and what holds for a whole span is computed once for it; the slots are
    laid out last, and no exchange or sort has them; ranks exchange days with their bars by date, sort the bars, and lay the slots out in order behind that. Lists with targets that need later slots, or ranks of them, go by the grid.
    """
    if isinstance(intraday, Spans):
        c = compiled(defs, intraday.columns, slots, intraday.flows)
        if c.plan.over_spans:
            o = c.over_spans()
            bars = (intraday.by_instrument if c.reads_history else intraday.bars).select(*c.KEYS, AT, TO, *c.inputs(intraday))
            if early := o.windowed.intersection({*c.plan.history, *c.plan.sums, *c.plan.deeper}):
                bars = by_bar(c.history(with_bars(daily, by_day(bars)), early, carry=[BARS]))
            bars = _stepwise(bars, o.before)
            bars = bars.select(*c.KEYS[:2], *[n for n in bars.columns if n in o.kept and n not in early])
            first = {n: own(n) for n in o.flows if n in bars.columns}
            steps = [first | o.slots[0], *o.slots[1:]]
            days = c.history(with_bars(daily, by_day(bars)), carry=[BARS]) if c.reads_history else bars
            if ranks:  # a cross-section's rows in one partition: days go there, narrower than the factors of their bars
                days = (days.where(F.col(BARS).isNotNull()) if c.reads_history else days).repartition(partitions(daily.sparkSession), "date")
            bars = _stepwise(by_bar(days) if c.reads_history else days, o.after)
            if ranks:
                read = {*c.KEYS, AT, TO, *(d.name for d in c.defs), *(n for made in steps for n, v in made.items() for n in (n, *re.findall(r"\w+", str(v))))}
                bars = in_turn(bars.select(*[n for n in bars.columns if n in read]))
            elif not raw:
                bars = bars.withColumns({f"_f_{d.name}": c.clipped(d) for d in c.defs if d.name not in c.plan.nature})
            return c.finished(_stepwise(laid_out(bars, turns=ranks), steps), ranks, raw, in_order=ranks)
        intraday = intraday.grid()
    c = compiled(defs, intraday.columns, slots)
    frame = intraday.select(*c.KEYS, *c.inputs(intraday))
    if c.reads_history:
        frame = frame.join(c.history(daily), ["date", "instrument"])
    for running, here in c.stages():
        for stage in running:
            frame = frame.withColumns({n: v.over_day() if isinstance(v, Recurrence) else v for n, v in stage.items()})
        plain = [d for d in here if d.kind != "rank_targets"]
        if plain:
            frame = frame.withColumns({d.name: c.built[d.name] for d in plain})
        frame = ranked_targets(frame, [d for d in here if d.kind == "rank_targets"])
    return c.finished(frame, ranks, raw)
