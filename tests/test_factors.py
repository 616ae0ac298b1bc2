"""Factors against naive recomputation in plain Python on a small random panel."""

import datetime as dt
import math
import random

import pytest

from tidegrid.operators import moments
from tidegrid.plans import groups
from tidegrid.plans.factors import FactorDef as Fd
from tidegrid.plans.factors import compile_factors, levels

DAYS, SLOTS, NAMES = 12, 6, ("a", "b", "c")


@pytest.fixture(scope="module")
def market(spark):
    r = random.Random(5)
    daily, bars = [], []
    for i in NAMES:
        price = 100.0
        for n in range(DAYS):
            date, ret = dt.date(2024, 1, 1) + dt.timedelta(n), r.gauss(0, 0.02)
            price *= math.exp(ret)
            daily.append((date, i, price, price * 1.01, price * 0.99, float(r.randint(50, 99)), ret, ret / 2, 2.0 if i == "b" and n > 6 else 1.0))
            for s in range(SLOTS):
                m = price * math.exp(r.gauss(0, 0.01))
                bars.append((date, i, s, m, float(r.randint(1, 9)), math.log(m / 100)))
    d = spark.createDataFrame(daily, "date date, instrument string, close double, high double, low double, volume double, daily_return double, alpha double, factor double")
    b = spark.createDataFrame(bars, "date date, instrument string, slot int, mid_price double, volume double, resid double")
    return daily, bars, d.cache(), b.cache()


def history(daily, i, date, w, field):
    rows = sorted(x for x in daily if x[1] == i and x[0] < date)[-w:] if w else []
    now = [x for x in daily if x[1] == i and x[0] == date][0]
    k = {"close": 2, "high": 3, "low": 4, "volume": 5, "daily_return": 6, "alpha": 7}[field]
    if field in ("close", "high", "low"):
        return [x[k] / x[8] * now[8] for x in rows]
    return [x[k] for x in rows]


def test_history_factors(market):
    daily, bars, d, b = market
    w = 5
    defs = [
        Fd("price_dev_from_ma", w, daily=("adjusted_close",), intraday=("mid_price",)),
        Fd("daily_mom", 1, daily=("adjusted_close",), intraday=("mid_price",)),
        Fd("price_position", w, daily=("adjusted_high", "adjusted_low"), intraday=("mid_price",)),
        Fd("daily_volatility", w, daily=("daily_return",), cache=("daily_mom_1",)),
        Fd("daily_skewness", w, daily=("daily_return",), cache=("daily_mom_1",)),
        Fd("daily_mom_sum", w, daily=("alpha",), intraday=("resid",)),
    ]
    mids = {(x[0], x[1], x[2]): (x[3], x[5]) for x in bars}
    last = dt.date(2024, 1, DAYS)
    rows = [r for r in compile_factors(defs, d, b, SLOTS, raw=True).collect() if r.date == last]
    assert len(rows) == len(NAMES) * SLOTS
    for r in rows:
        p, resid = mids[r.date, r.instrument, r.slot]
        close = history(daily, r.instrument, last, w, "close")
        assert r[f"price_dev_from_ma_{w}"] == pytest.approx((math.log(p) - math.log(sum(close) / w)) / math.sqrt(w))
        mom = math.log(p) - math.log(close[-1])
        assert r["daily_mom_1"] == pytest.approx(mom)
        hi, lo = max(*history(daily, r.instrument, last, w, "high"), p), min(*history(daily, r.instrument, last, w, "low"), p)
        assert r[f"price_position_{w}"] == pytest.approx((p - lo) / (hi - lo))
        x = [*history(daily, r.instrument, last, w - 1, "daily_return"), mom]
        assert r[f"daily_volatility_{w}"] == pytest.approx(math.sqrt(sum(v * v for v in x) / w))
        mu = sum(x) / w
        m2, m3 = sum((v - mu) ** 2 for v in x) / w, sum((v - mu) ** 3 for v in x) / w
        assert r[f"daily_skewness_{w}"] == pytest.approx(m3 / m2**1.5, rel=1e-6)
        assert r[f"daily_mom_sum_{w}"] == pytest.approx((resid + sum(history(daily, r.instrument, last, w - 1, "alpha"))) / math.sqrt(w))


def test_running_day(market):
    _, bars, d, b = market
    defs = [Fd("today_volatility", intraday=("resid",)), Fd("today_std", intraday=("volume",)), Fd("today_amount_ratio", intraday=("volume", "volume"))]
    got = {(r.date, r.instrument, r.slot): r for r in compile_factors(defs, d, b, SLOTS, raw=True).collect()}
    for i in NAMES:
        day = sorted(x for x in bars if x[1] == i and x[0] == dt.date(2024, 1, 3))
        for n in range(SLOTS):
            diff = [day[0][5]] + [day[k][5] - day[k - 1][5] for k in range(1, n + 1)]
            s = sum(v * v for v in diff)
            row = got[day[n][0], i, n]
            assert row.today_volatility == pytest.approx(math.sqrt(s / n) if n else math.sqrt(s) / 2)
            logs = [math.log1p(x[4]) for x in day[: n + 1]]
            mu = sum(logs) / len(logs)
            assert row.today_std == pytest.approx(math.sqrt(sum((v - mu) ** 2 for v in logs) / len(logs)), abs=1e-9)


def test_long_windows_agree_with_frames(market):
    from pyspark.sql import functions as F

    from tidegrid.operators import windows

    _, _, d, _ = market
    kept = windows.PREFIX_FROM
    try:
        sums = {"s": (F.col("daily_return"), 7), "n": (F.col("volume"), 3)}
        frames = {(r.date, r.instrument): (r.s, r.n) for r in windows.with_history_sums(d, sums).collect()}
        windows.PREFIX_FROM = 1
        prefix = {(r.date, r.instrument): (r.s, r.n) for r in windows.with_history_sums(d, sums).collect()}
    finally:
        windows.PREFIX_FROM = kept
    assert all(frames[k] == pytest.approx(prefix[k]) for k in frames)


def test_clip_follows_shift_and_scale(market):
    _, _, d, b = market
    raw = Fd("id", intraday=("mid_price",), shift=100, scale=10, lower=-1, upper=2)
    values = {r.id_mid_price for r in compile_factors([raw], d, b, SLOTS).collect()}
    assert min(values) >= -1 and max(values) <= 2


def test_dependencies():
    a = Fd("abs", cache=("abs_b",))
    with pytest.raises(ValueError, match="no factor makes"):
        levels([a], ["b"])
    with pytest.raises(ValueError, match="circular"):
        levels([Fd("today_mom", cache=("b_today_mom",), prefix="a_"), Fd("today_mom", cache=("a_today_mom",), prefix="b_")], [])


def test_arity(market):
    _, _, d, b = market
    with pytest.raises(ValueError, match="takes 2 daily"):
        compile_factors([Fd("price_position", 5, daily=("close",), intraday=("mid_price",))], d, b, SLOTS)


@pytest.mark.parametrize(("name", "n"), [("default", 58), ("filters", 4), ("targets_with_costs_10m_3D", 7), ("targets_with_costs_10m_3D_with_range", 16), ("targets_with_costs_10m_3D_with_rank", 14), ("targets_midprice_10m_3D_with_rank", 14), ("lib", 12), ("fg260112", 93), ("fg260113", 103), ("fg260114", 116)])
def test_group_sizes(name, n):
    defs = groups.group(name)
    assert len({d.name for d in defs}) == len(defs) == n


def test_moments_of_few_values(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[moments.skewness(*[F.lit(float(v)) for v in (n, n, n, n)]).alias(f"s{n}") for n in (2, 3)]).first()
    assert row.s2 is None and row.s3 == 0.0


def test_one_exchange_for_history_and_none_more_for_the_day(market):
    _, _, d, b = market
    plan = compile_factors(groups.group("lib"), d, b.withColumn("ask_price1", b.mid_price), SLOTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CartesianProduct") == 0 and plan.count("Python") == 0


def test_no_factor_of_a_long_history_is_wholly_missing(spark):
    """Half months as days: the longest windows are full, so that their columns are compared on values."""
    from pyspark.sql import functions as F

    from tidegrid import catalogue

    folder = "/root/testdata/sf0.01"
    counts = catalogue.QUERIES["group_fg260114_long"](spark, folder)
    counts = counts.agg(*[F.count(c).alias(c) for c in counts.columns]).first().asDict()
    assert len(counts) == 119 and min(counts.values()) > 1000
