"""Named factor groups. Windows, inputs, shifts and scales are fixed values of the data model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from tidegrid.plans.factors import FactorDef as Fd

LONG = (5, 10, 21, 63, 126)
MID = "mid_price"
RESID = "resid"
GROUPS: dict[str, Callable[..., list[Fd]]] = {}


def register_group(name: str):
    def put(f):
        if name in GROUPS:
            raise ValueError(f"group {name} is registered already")
        GROUPS[name] = f
        return f

    return put


def group(name: str, windows: Sequence[int] | None = None) -> list[Fd]:
    """The factors of a group; windows: only those windows, for short histories (factors without one stay)."""
    if name not in GROUPS:
        raise ValueError(f"no group {name}")
    every = GROUPS[name]()
    if windows is None:
        return every
    kept = [d for d in every if not d.window or d.window in windows]
    names = {d.name for d in kept}
    missing = {i for d in kept for i in d.cache} - names
    return [d for d in kept if not (set(d.cache) & {m for m in missing if any(m == e.name for e in every)})]


def _each(windows: Sequence[int], **kw) -> list[Fd]:
    return [Fd(window=w, **kw) for w in windows]


@register_group("default")
def default() -> list[Fd]:
    price = dict(daily=("adjusted_close",), intraday=(MID,))
    back = dict(daily=("daily_return",), cache=("daily_mom_1",))
    rest = dict(daily=("alpha",), intraday=(RESID,))
    return [
        *_each(LONG, kind="price_dev_from_ma", scale=100, **price),
        *_each(LONG, kind="price_dev_from_vwap", daily=("adjusted_close", "volume"), intraday=(MID,), scale=100),
        *_each(LONG, kind="price_position", daily=("adjusted_high", "adjusted_low"), intraday=(MID,), shift=0.5, scale=5),
        *_each((1, 2, *LONG), kind="daily_mom", scale=50, **price),
        *_each((2, *LONG), kind="daily_volatility", shift=0.025, scale=100, **back),
        *_each(LONG, kind="daily_skewness", **back),
        *_each(LONG[1:], kind="daily_kurtosis", scale=0.5, **back),
        *[Fd(kind="daily_volvol", window=w, window2=3 * w, shift=0.01, scale=200, **back) for w in (2, 5, 10, 21)],
        *_each((2, *LONG), kind="daily_mom_sum", scale=50, **rest),
        *_each((2, *LONG), kind="daily_volatility", prefix="alpha_", shift=0.02, scale=100, **rest),
        *_each(LONG, kind="daily_skewness", prefix="alpha_", **rest),
    ]


@register_group("filters")
def filters() -> list[Fd]:
    return [
        Fd("is_tradable", daily=("adjusted_close",), intraday=("bid_price1", "ask_volume1", "bid_volume1")),
        *_each((1, 3, 5), kind="daily_recent_vacancy", daily=("adjusted_close",)),
    ]


def _targets(buy: str, sell: str) -> list[Fd]:
    return [
        *_each((3, 2, 1, 0), kind="future_day_targets", future=("adjusted_close",), intraday=(buy, MID)),
        *_each((60, 30, 10), kind="today_targets", intraday=(buy, sell, MID)),
    ]


def _ranked(defs: Sequence[Fd]) -> list[Fd]:
    return [x for d in defs for x in (d, Fd("rank_targets", cache=(d.name,)))]


@register_group("targets_with_costs_10m_3D")
def targets() -> list[Fd]:
    return _targets("ask_price1", "bid_price1")


@register_group("targets_with_costs_10m_3D_with_rank")
def ranked_targets() -> list[Fd]:
    return _ranked(targets())


@register_group("targets_midprice_10m_3D_with_rank")
def ranked_mid_targets() -> list[Fd]:
    return _ranked(_targets(MID, MID))


@register_group("targets_with_costs_10m_3D_with_range")
def range_targets() -> list[Fd]:
    days, hi, lo = (3, 2, 1), "adjusted_high", "adjusted_low"
    return [
        *targets(),
        *_each(days, kind="future_day_range_targets", future=(hi, lo)),
        *_each(days, kind="future_day_up_range_targets", future=(hi,), intraday=(MID,)),
        *_each(days, kind="future_day_down_range_targets", future=(lo,), intraday=(MID,)),
    ]


@register_group("lib")
def lib() -> list[Fd]:
    """One window of each family."""
    price = dict(daily=("adjusted_close",), intraday=(MID,))
    back = dict(daily=("daily_return",), cache=("daily_mom_1",))
    rest = dict(daily=("alpha",), intraday=(RESID,))
    return [
        Fd("price_dev_from_ma", 10, scale=100, **price),
        Fd("price_dev_from_vwap", 10, daily=("adjusted_close", "volume"), intraday=(MID,), scale=100),
        Fd("price_position", 10, daily=("adjusted_high", "adjusted_low"), intraday=(MID,), shift=0.5, scale=5),
        Fd("daily_mom", 1, scale=50, **price),
        Fd("daily_mom", 10, scale=50, **price),
        Fd("daily_volatility", 10, shift=0.025, scale=100, **back),
        Fd("daily_skewness", 21, **back),
        Fd("daily_kurtosis", 63, scale=0.5, **back),
        Fd("daily_volvol", 10, window2=30, shift=0.01, scale=200, **back),
        Fd("daily_mom_sum", 10, scale=50, **rest),
        Fd("daily_volatility", 10, prefix="alpha_", shift=0.02, scale=100, **rest),
        Fd("daily_skewness", 21, prefix="alpha_", **rest),
    ]


@register_group("fg260112")
def fg260112() -> list[Fd]:
    twins = [Fd("abs", cache=(d.name,)) for d in default() if d.kind in ("price_dev_from_ma", "price_dev_from_vwap", "daily_mom", "daily_mom_sum")]
    volvol = [Fd("daily_volvol", w, window2=3 * w, prefix="alpha_", daily=("alpha",), intraday=(RESID,), shift=0.01, scale=200) for w in (2, 5, 10, 21)]
    day = [
        Fd("today_mom", cache=("daily_mom_1",), scale=50),
        Fd("today_volatility", cache=("daily_mom_1",), scale=200),
        Fd("today_skewness", cache=("daily_mom_1",)),
        Fd("today_position", intraday=(MID, "high", "low"), shift=0.5, scale=2),
        Fd("today_mom", intraday=(RESID,), prefix="resid_", scale=50),
        Fd("today_volatility", intraday=(RESID,), prefix="resid_", scale=200),
        Fd("today_skewness", intraday=(RESID,), prefix="resid_"),
        Fd("today_position", intraday=(RESID,) * 3, prefix="resid_", shift=0.5, scale=2),
    ]
    return [*default(), *twins, *volvol, *day]


@register_group("fg260113")
def fg260113() -> list[Fd]:
    return [
        *fg260112(),
        *_each(LONG, kind="volume_ratio", daily=("adjusted_volume",), intraday=("total_volume",)),
        *_each(LONG, kind="rv_corr", daily=("daily_return", "adjusted_volume"), cache=("daily_mom_1",), intraday=("total_volume",), scale=5),
    ]


@register_group("fg260114")
def fg260114() -> list[Fd]:
    return [
        *fg260113(),
        *_each(LONG, kind="rv_corr", prefix="alpha_", daily=("alpha", "adjusted_volume"), intraday=(RESID, "total_volume"), scale=5),
        Fd("id", intraday=("resid_rank",), shift=0.5, scale=4),
        Fd("today_mom", intraday=("resid_rank",), prefix="resid_rank_"),
        Fd("today_std", intraday=("volume",), prefix="volume_"),
        Fd("today_log_skewness", intraday=("volume",), prefix="volume_"),
        Fd("today_amount_ratio", intraday=("buy_amount", "amount"), prefix="buy_"),
        Fd("today_amount_ratio", intraday=("sell_amount", "amount"), prefix="sell_"),
        Fd("abs", cache=("today_mom",), scale=50),
        Fd("abs", cache=("resid_today_mom",), scale=50),
    ]
