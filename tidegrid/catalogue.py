"""Every registered query of the panel library with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid import oracles as o
from tidegrid.functions import ln, nearest, rounded
from tidegrid.models import mlp
from tidegrid.operators import panel as pn
from tidegrid.operators import windows as wd
from tidegrid.operators import xsection as xs
from tidegrid.plans import datasets, groups, neutral, stats
from tidegrid.plans import evaluate as ev
from tidegrid.plans.factors import FactorDef as Fd
from tidegrid.plans.factors import compile_factors
from tidegrid.plans.daily import DayLoop
from tidegrid.plans.online import Online
from tidegrid.session import short_methods
from tidegrid.sources import bars
from tidegrid.sources.bars import SLOTS
from tidegrid.sources.store import PanelStore, Variable, shared_folder
from tidegrid.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Floats rounded and integers as longs, so that engines can be compared value by value."""
    out = rounded(df)
    return out.select(*[F.col(c).cast("bigint").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in out.dtypes])


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            short_methods(spark)
            return comparable(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


KEY, SLOTKEY = ["date", "instrument"], ["date", "instrument", "slot"]


def daily(s: SparkSession, d: str) -> DataFrame:
    return bars.daily_panel(s, d)


def dense(s: SparkSession, d: str) -> DataFrame:
    return bars.dense_daily(bars.daily_panel(s, d))


def intra(s: SparkSession, d: str) -> DataFrame:
    return bars.intraday_panel(s, d)


def pred(s: SparkSession, d: str) -> DataFrame:
    return bars.pred_panel(s, d)


def month(s: SparkSession, d: str) -> DataFrame:
    return pn.densify(bars.month_panel(s, d).drop("factor"))


# Panel algebra -----------------------------------------------------------------------

ALL = ["open", "high", "low", "close", "volume", "amount", "factor", "daily_return", "alpha"]
query("panel_daily_ohlcv", o.pick(o.DAILY, "daily", KEY, ALL))(daily)
query("panel_intraday_bars", o.pick(f"{o.EVENTS},\n{o.INTRA}", "intra", SLOTKEY, [*o._PRICES, *o._FLOWS, "resid"]))(lambda s, d: intra(s, d).select(*SLOTKEY, *o._PRICES, *o._FLOWS, "resid"))


@query("panel_project_filter_between", o.pick(o.DAILY, "daily", KEY, ["close", "volume"], "WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND instrument = 3"))
def _project(s, d):
    return pn.fields(pn.between(daily(s, d), "2024-01-05", "2024-01-12").where("instrument = 3"), ["close", "volume"])


@query("panel_filter_instrument_count", o.pick(o.DAILY, "daily", KEY, ["close"], "QUALIFY count(*) OVER (PARTITION BY instrument) > 26"))
def _count_filter(s, d):
    return pn.with_more_rows_than(daily(s, d), 26).select(*KEY, "close")


@query("panel_recent_count", o.pick(o.DAILY, "(SELECT *, count(*) OVER (PARTITION BY instrument ORDER BY date RANGE BETWEEN INTERVAL 9 DAY PRECEDING AND CURRENT ROW) AS k FROM daily)", KEY, ["close"], "WHERE k > 8"))
def _recent_count(s, d):
    return pn.with_recent_rows(daily(s, d), 8, 9).select(*KEY, "close")


query("panel_densify_fill", o.pick(o.DENSE, "dense", KEY, ALL))(lambda s, d: dense(s, d).select(*KEY, *ALL))

_FIRST = "first_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("panel_backfill", o.pick(f"{o.DENSE}, x AS (SELECT date, instrument, {_FIRST} AS close FROM dense)", "x", KEY, ["close"]))
def _backfill(s, d):
    return pn.backfill(dense(s, d).select(*KEY, "close"), ["instrument"], "date", ["close"])


@query("panel_validity", f"WITH {o.DENSE}, j AS (SELECT g.date, g.instrument, p.close FROM dense g LEFT JOIN daily p ON p.date = g.date AND p.instrument = g.instrument) SELECT DISTINCT instrument, count(*) FILTER (WHERE close IS NULL) OVER (PARTITION BY instrument) < 4 AS is_valid FROM j")
def _validity(s, d):
    gaps = pn.densify(daily(s, d).select(*KEY, "close"), ffill=False)
    return pn.validity(gaps, ["close"], max_missing=4).select("instrument", "is_valid").distinct()


@query("time_grid", "SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS slot FROM (SELECT TIMESTAMP '2024-01-05 09:25:00' AS datetime UNION SELECT unnest(generate_series(TIMESTAMP '2024-01-05 09:30:00', TIMESTAMP '2024-01-05 11:29:00', INTERVAL 1 MINUTE)) UNION SELECT unnest(generate_series(TIMESTAMP '2024-01-05 13:00:00', TIMESTAMP '2024-01-05 14:56:00', INTERVAL 1 MINUTE)))")
def _time_grid(s, d):
    return pn.time_grid(s, "2024-01-05")


_ANCHOR = "{f}(factor IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
for _last, _f in ((True, "last_value"), (False, "first_value")):
    _a = _ANCHOR.format(f=_f)
    query(f"adjust_by_{'last' if _last else 'first'}", o.pick(f"{o.DAILY}, x AS (SELECT *, {_a} AS a FROM daily)", "x", KEY, {"adjusted_close": "close / factor * a", "adjusted_volume": "volume * factor / a"}))(
        lambda s, d, last=_last: pn.adjusted(daily(s, d), ["close", "volume"], last=last).select(*KEY, "adjusted_close", "adjusted_volume")
    )


@query("align_semi", o.pick(o.DAILY, "daily", KEY, ["close"], "WHERE (date, instrument) IN (SELECT date, instrument FROM daily WHERE volume > 1)"))
def _align(s, d):
    p = daily(s, d)
    return pn.align(p, p.where("volume > 1"), strict=False).select(*KEY, "close")


@query("incremental_anti", f"WITH {o.EVENTS} SELECT DISTINCT date FROM e WHERE date NOT IN (SELECT date FROM e WHERE event_type = 'signup' AND instrument < 2)")
def _todo(s, d):
    e = bars.events(s, d)
    return pn.missing_dates(e, e.where("event_type = 'signup' AND instrument < 2"))


_SETS = {"a": "value > 40", "b": "event_type = 'view' AND value > 20"}


@query("date_set_ops", f"WITH {o.EVENTS}, a AS (SELECT DISTINCT date, instrument FROM e WHERE {_SETS['a']}), b AS (SELECT DISTINCT date, instrument FROM e WHERE {_SETS['b']}) SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', * FROM (SELECT * FROM a UNION SELECT * FROM b)")
def _sets(s, d):
    e = bars.events(s, d)
    a, b = (e.where(_SETS[k]).select(*KEY).distinct() for k in "ab")
    tag = lambda name, df: df.select(F.lit(name).alias("part"), *KEY)
    return tag("both", pn.common_keys(a, b)).union(tag("only_a", a.exceptAll(b))).union(tag("any", a.union(b).distinct()))


# Two panels with other keys: days with a view and days with a click.
_X = "SELECT date, instrument, max(px) AS close FROM e WHERE event_type = 'view' GROUP BY date, instrument"
_Y = "SELECT date, instrument, CAST(count(*) AS DOUBLE) AS volume FROM e WHERE event_type = 'click' GROUP BY date, instrument"


def _viewed(s, d):
    return bars.events(s, d).where("event_type = 'view'").groupBy(*KEY).agg(F.max("px").alias("close"))


def _clicked(s, d):
    return bars.events(s, d).where("event_type = 'click'").groupBy(*KEY).agg(F.count("*").cast("double").alias("volume"))


for _how in ("left", "inner", "full"):
    query(f"merge_{'outer' if _how == 'full' else _how}", o.pick(f"{o.EVENTS}, a AS ({_X}), b AS ({_Y})", f"a {_how} JOIN b USING (date, instrument)", KEY, ["close", "volume"]))(lambda s, d, how=_how: pn.merge(_viewed(s, d), _clicked(s, d), how))


@query("series_side_by_side", o.pick(f"{o.DAILY}, a AS ({_X}), b AS ({_Y}), c AS (SELECT date, instrument, high FROM daily WHERE volume > 2)", "a FULL JOIN b USING (date, instrument) FULL JOIN c USING (date, instrument)", KEY, ["close", "volume", "high"]))
def _side(s, d):
    return pn.side_by_side([_viewed(s, d), _clicked(s, d), daily(s, d).where("volume > 2").select(*KEY, "high")])


@query("execution_period", o.pick(f"{o.EVENTS},\n{o.INTRA}", "intra", SLOTKEY, ["mid_price"], "WHERE slot % 2 = 0 AND slot / 2 >= 7"))
def _execution(s, d):
    return pn.execution_period(intra(s, d), "close", 2, slots=SLOTS).select(*SLOTKEY, "mid_price")


_INSIDE = "slot >= 6 AND slot < 18"


@query(
    "sample_one_slot",
    f"WITH {o.EVENTS},\n{o.INTRA} SELECT date, count(DISTINCT instrument) AS drawn, count(DISTINCT instrument) AS inside, 0::BIGINT AS foreign_rows FROM intra WHERE {_INSIDE} GROUP BY date",
)
def _one_slot(s, d):
    """What any draw must fulfil, by date: one row an instrument, in the period, and a row of the panel."""
    panel = intra(s, d)
    drawn = pn.one_random_slot(panel, 7, period=(6, 18))
    foreign = drawn.join(panel.select(*SLOTKEY, F.col("mid_price").alias("m")), SLOTKEY, "left").withColumn("f", ~F.col("mid_price").eqNullSafe(F.col("m")))
    place = F.floor((F.col("slot") - 6) / 12.0 * 240)
    return foreign.groupBy("date").agg(F.count("*").alias("drawn"), F.count_if(F.expr(_INSIDE) & (F.col("position") == place)).alias("inside"), F.count_if("f").alias("foreign_rows"))


@query("train_part", o.pick(o.DAILY, "daily", KEY, ["close"], "WHERE date >= DATE '2024-01-03' AND date < DATE '2024-01-20'"))
def _train(s, d):
    return pn.train_part(daily(s, d), "2024-01-03", "2024-01-20").select(*KEY, "close")


@query("sample_timestamps", f"WITH {o.EVENTS},\n{o.HOURLY}, m AS (SELECT unnest([0, 1, 2, 4, 6, 9, 12, 16, 20, 22, 23]) AS mark) SELECT date, instrument, slot, max(mark) AS mark FROM (SELECT date, instrument, mark, min(slot) AS slot FROM h1 JOIN m ON slot >= mark GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
def _sampled(s, d):
    return pn.first_at_or_after(bars.hourly_bars(s, d).select(*SLOTKEY), [0, 1, 2, 4, 6, 9, 12, 16, 20, 22, 23], "slot", KEY).select(*SLOTKEY, "mark")


# History, running day, future --------------------------------------------------------------

_B5 = o.back(5)


def _hist(name: str, sql: dict[str, str], build: Callable[[], dict]) -> None:
    query(name, o.pick(f"{o.DENSE}, x AS (SELECT *, {', '.join(f'{x} AS x_{n}' for n, x in sql.items())} FROM dense)", "x", KEY, {n: f"x_{n}" for n in sql}))(
        lambda s, d: dense(s, d).withColumns(c := build()).select(*KEY, *c)
    )


_hist("hist_lag", {"yest": f"lag(close) {o.BY_DAY}", "lag5": f"lag(close, 5) {o.BY_DAY}"}, lambda: {"yest": wd.yesterday("close"), "lag5": wd.lag_filled("close", 5)})
_hist("hist_ma", {"ma5": f"avg(close) {_B5}", "ma10": f"avg(amount) {o.back(10)}"}, lambda: {"ma5": wd.mean("close", 5), "ma10": wd.mean("amount", 10)})
_hist("hist_vwap", {"vwap5": f"CASE WHEN coalesce(sum(volume) {_B5}, 0) = 0 THEN avg(close) {_B5} ELSE coalesce(sum(close * volume) {_B5}, 0) / (coalesce(sum(volume) {_B5}, 0) + 1e-6) END"}, lambda: {"vwap5": wd.vwap("close", "volume", 5)})
_hist("hist_high_low", {"high5": f"max(high) {_B5}", "low5": f"min(low) {_B5}"}, lambda: {"high5": wd.high("high", 5), "low5": wd.low("low", 5)})
_hist("hist_valid_ratio", {"valid5": f"count(close) {_B5} / 5.0"}, lambda: {"valid5": wd.valid_ratio("close", 5)})
_hist("hist_pow_sum", {f"p{k}": o.power("daily_return", k, 5) for k in (0, 1, 2, 3, 4)}, lambda: {f"p{k}": wd.pow_sum("daily_return", k, 5) for k in (0, 1, 2, 3, 4)})
_hist("hist_prod_sum", {"rv5": f"coalesce(sum(daily_return * volume) {_B5}, 0)"}, lambda: {"rv5": wd.product_sum("daily_return", "volume", 5)})
_W = f"3 * sqrt(avg(daily_return * daily_return) {_B5})"
_hist("hist_winsor", {"r": f"CASE WHEN {_W} IS NULL THEN daily_return ELSE greatest(least(daily_return, {_W}), -{_W}) END"}, lambda: {"r": wd.winsorized("daily_return", 5)})
_R5 = "OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_hist("hist_rolling_moment", {"m2": f"CASE WHEN count(*) {_R5} >= 5 THEN coalesce(sum(daily_return * daily_return) {_R5}, 0) / 5 END"}, lambda: {"m2": wd.rolling_moment("daily_return", 2, 5)})
_hist("hist_recent_value", {"alpha": f"last_value(alpha IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}, lambda: {"alpha": wd.recent("alpha")})
_LONG = {"s21": ("daily_return", 21), "q63": ("daily_return * daily_return", 63), "v63": ("volume", 63)}


@query("hist_long_windows", o.pick(f"{o.MONTH_DENSE}, x AS (SELECT date, instrument, {', '.join(f'coalesce(sum({t}) {o.back(w)}, 0) AS {n}' for n, (t, w) in _LONG.items())} FROM dense)", "x", KEY, list(_LONG)))
def _long(s, d):
    return wd.with_history_sums(month(s, d), {n: (F.expr(t), w) for n, (t, w) in _LONG.items()}).select(*KEY, *_LONG)


_hist("future_ndays", {f"f{k}": f"lead(close, {k}) {o.BY_DAY}" for k in (1, 3)}, lambda: {f"f{k}": wd.future("close", k) for k in (1, 3)})
_AH = "OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)"
_hist("future_extremes", {"hi3": f"max(high) {_AH}", "lo3": f"min(low) {_AH}"}, lambda: {"hi3": wd.future_high("high", 3), "lo3": wd.future_low("low", 3)})
_hist("future_sum", {"s3": f"coalesce(sum(daily_return) {_AH}, 0)", "over_close": f"lead(close, 3) {o.BY_DAY} / close"}, lambda: {"s3": wd.future_sum("daily_return", 3), "over_close": F.try_divide(wd.future("close", 3), F.col("close"))})


@query("today_open_diff_cumsum_highlow_fraction", o.pick(f"{o.EVENTS},\n{o.INTRA}, x AS (SELECT *, first_value(mid_price) {o.RUN} AS o, coalesce(mid_price - lag(mid_price) {o.SLOT}, mid_price) AS d, sum(volume) {o.RUN} AS t, max(high) {o.RUN} AS hi, min(low) {o.RUN} AS lo, (slot + 1) / 24.0 AS f FROM intra)", "x", SLOTKEY, ["o", "d", "t", "hi", "lo", "f"]))
def _running(s, d):
    return intra(s, d).select(*SLOTKEY, wd.opening("mid_price").alias("o"), wd.change("mid_price").alias("d"), wd.total("volume").alias("t"), wd.high_so_far("high").alias("hi"), wd.low_so_far("low").alias("lo"), wd.time_fraction(SLOTS).alias("f"))


@query("intraday_return_ahead", o.pick(f"{o.EVENTS},\n{o.INTRA}, x AS (SELECT *, {o.ln(f'coalesce(lead(mid_price, 3) {o.SLOT}, last_value(mid_price) {o.REST})')} - {o.ln('mid_price')} AS r3, {o.ln(f'last_value(mid_price) {o.REST}')} - {o.ln('mid_price')} AS rc FROM intra)", "x", SLOTKEY, ["r3", "rc"]))
def _ahead(s, d):
    return intra(s, d).select(*SLOTKEY, wd.return_ahead("mid_price", 3).alias("r3"), wd.return_ahead("mid_price", -1).alias("rc"))


# Factors -------------------------------------------------------------------------------------


def factors(s: SparkSession, d: str, defs: list[Fd], raw: bool = True, ranks: bool = False) -> DataFrame:
    return compile_factors(defs, dense(s, d), bars.intraday_spans(s, d), SLOTS, ranks=ranks, raw=raw)


def _factor(name: str, defs: list[Fd], day: dict, final: dict, running=(), day2=None, keep: list[str] | None = None) -> None:
    query(name, o.factor_sql(day, final, running, day2))(lambda s, d: factors(s, d, defs).select(*SLOTKEY, *(keep or [x.name for x in defs])))


MID, L = "mid_price", o.ln
_mom1 = Fd("daily_mom", 1, daily=("adjusted_close",), intraday=(MID,))
_back = dict(daily=("daily_return",), cache=("daily_mom_1",))
_Y1 = {"y": o.YEST}
_M1 = f"({o.MOM1})"

_factor("f_daily_mom", [Fd("daily_mom", 5, daily=("adjusted_close",), intraday=(MID,))], {"c5": f"lag({o.AC}, 5) {o.BY_DAY} * factor"}, {"daily_mom_5": f"({L(MID)} - {L('c5')}) / sqrt(5)"})
_factor("f_price_dev_ma", [Fd("price_dev_from_ma", 5, daily=("adjusted_close",), intraday=(MID,))], {"m": f"avg({o.AC}) {_B5} * factor"}, {"price_dev_from_ma_5": f"({L(MID)} - {L('m')}) / sqrt(5)"})
_factor(
    "f_price_dev_vwap",
    [Fd("price_dev_from_vwap", 5, daily=("adjusted_close", "volume"), intraday=(MID,))],
    {"m": f"CASE WHEN coalesce(sum(volume) {_B5}, 0) = 0 THEN avg({o.AC}) {_B5} * factor ELSE coalesce(sum({o.AC} * volume) {_B5}, 0) * factor / (coalesce(sum(volume) {_B5}, 0) + 1e-6) END"},
    {"price_dev_from_vwap_5": f"({L(MID)} - {L('m')}) / sqrt(5)"},
)
_factor("f_price_dev_yest", [Fd("price_dev_from_yest_vwap", 0, daily=("adjusted_close",), intraday=(MID,))], _Y1, {"price_dev_from_yest_vwap": o.MOM1})
_factor(
    "f_price_position",
    [Fd("price_position", 5, daily=("adjusted_high", "adjusted_low"), intraday=(MID,))],
    {"h5": f"max(high / factor) {_B5} * factor", "l5": f"min(low / factor) {_B5} * factor"},
    {"price_position_5": f"CASE WHEN h5 IS NOT NULL AND greatest(h5, {MID}) > least(l5, {MID}) THEN ({MID} - least(l5, {MID})) / (greatest(h5, {MID}) - least(l5, {MID})) END"},
)
_factor("f_mom_sum", [Fd("daily_mom_sum", 5, daily=("alpha",), intraday=("resid",))], {"a4": o.power("alpha", 1, 4)}, {"daily_mom_sum_5": "(resid + a4) / sqrt(5)"})
_factor("f_intraday_mom", [Fd("intraday_mom", 0, intraday=(MID,))], {}, {"intraday_mom": f"{L(MID)} - {L('o')}"}, [{"o": f"first_value({MID}) {o.RUN}"}])
_sums = {f"s{k}": o.power("daily_return", k, 4) for k in range(5)}
_with = {k: f"(s{k} + {' * '.join([_M1] * k)})" for k in (1, 2, 3, 4)}
_factor("f_volatility", [_mom1, Fd("daily_volatility", 5, **_back)], _Y1 | _sums, {"daily_volatility_5": f"sqrt({_with[2]} / (s0 + 1))"}, keep=["daily_volatility_5"])
_factor("f_skewness", [_mom1, Fd("daily_skewness", 5, **_back)], _Y1 | _sums, {"daily_skewness_5": o.skew_pop("(s0 + 1)", _with[1], _with[2], _with[3])}, keep=["daily_skewness_5"])
_factor("f_kurtosis", [_mom1, Fd("daily_kurtosis", 5, **_back)], _Y1 | _sums, {"daily_kurtosis_5": f"CASE WHEN s0 + 1 >= 5 THEN {o.kurt('5.0', *(_with[k] for k in (1, 2, 3, 4)))} END"}, keep=["daily_kurtosis_5"])
_R2 = "OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"
_factor(
    "f_volvol",
    [_mom1, Fd("daily_volvol", 2, window2=6, **_back)],
    _Y1 | {"v": f"CASE WHEN count(*) {_R2} >= 2 THEN sqrt(sum(daily_return * daily_return) {_R2} / 2) END", "q1": o.power("daily_return", 2, 1)},
    {"daily_volvol_2": f"CASE WHEN v1 IS NOT NULL AND {_M1} IS NOT NULL THEN sqrt(greatest((v2 + (q1 + {_M1} * {_M1}) / 2) / 6 - pow((v1 + sqrt((q1 + {_M1} * {_M1}) / 2)) / 6, 2), 0)) END"},
    day2={"v1": f"CASE WHEN count(v) {_B5} >= 5 THEN sum(v) {_B5} END", "v2": f"CASE WHEN count(v) {_B5} >= 5 THEN sum(v * v) {_B5} END"},
    keep=["daily_volvol_2"],
)
_TV = {"t": f"sum(total_volume) {o.RUN}"}
_factor(
    "f_volume_ratio",
    [Fd("volume_ratio", 5, daily=("adjusted_volume",), intraday=("total_volume",))],
    {"m": f"avg(volume * factor) {_B5} / factor"},
    {"volume_ratio_5": f"{L('(t + 1) / ((slot + 1) / 24.0)')} - {L('m')}"},
    [_TV],
)
_V = "(t / ((slot + 1) / 24.0))"
_OK = "CASE WHEN factor IS NOT NULL THEN"
_factor(
    "f_rv_corr",
    [_mom1, Fd("rv_corr", 5, daily=("daily_return", "adjusted_volume"), cache=("daily_mom_1",), intraday=("total_volume",))],
    _Y1
    | {
        "n": f"CAST(count(volume * factor) {o.back(4)} AS DOUBLE) + 1",
        "sx": f"coalesce(sum({_OK} daily_return END) {o.back(4)}, 0)",
        "sxx": f"coalesce(sum({_OK} daily_return * daily_return END) {o.back(4)}, 0)",
        "sy": f"coalesce(sum(volume * factor) {o.back(4)}, 0) / factor",
        "syy": f"coalesce(sum(volume * factor * volume * factor) {o.back(4)}, 0) / (factor * factor)",
        "sxy": f"coalesce(sum(daily_return * volume * factor) {o.back(4)}, 0) / factor",
    },
    {
        "rv_corr_5": f"CASE WHEN n >= 2 AND n * (sxx + {_M1} * {_M1}) - pow(sx + {_M1}, 2) > 1e-12 AND n * (syy + {_V} * {_V}) - pow(sy + {_V}, 2) > 1e-12 THEN "
        f"(n * (sxy + {_M1} * {_V}) - (sx + {_M1}) * (sy + {_V})) / sqrt((n * (sxx + {_M1} * {_M1}) - pow(sx + {_M1}, 2)) * (n * (syy + {_V} * {_V}) - pow(sy + {_V}, 2))) END"
    },
    [_TV],
    keep=["rv_corr_5"],
)
_factor(
    "f_obv_ratio",
    [_mom1, Fd("daily_on_balance_volume_ratio", 5, daily=("daily_return", "adjusted_volume"), cache=("daily_mom_1",), intraday=("total_volume",))],
    _Y1 | {"b": f"coalesce(sum(sign(daily_return) * volume * factor) {o.back(4)}, 0) / factor", "m": f"avg(volume * factor) {_B5} / factor"},
    {"daily_on_balance_volume_ratio_5": f"(b / 5 + {_V} * sign({_M1}) / 5) / (m + 1)"},
    [_TV],
    keep=["daily_on_balance_volume_ratio_5"],
)
_factor("f_amount_ratio", [Fd("today_amount_ratio", intraday=("buy_amount", "amount"))], {}, {"today_amount_ratio": "a / (b + 1)"}, [{"a": f"sum(buy_amount) {o.RUN}", "b": f"sum(amount) {o.RUN}"}])
_factor("f_today_mom", [_mom1, Fd("today_mom", cache=("daily_mom_1",))], _Y1, {"today_mom": "r - ro"}, [{"r": _M1}, {"ro": f"first_value(r) {o.RUN}"}], keep=["today_mom"])
_DR = [{"v": f"CASE WHEN slot = 0 THEN resid ELSE resid - lag(resid) {o.SLOT} END"}, {"n": f"CAST(count(v) {o.RUN} AS DOUBLE)"} | {f"s{k}": f"sum({' * '.join(['v'] * k)}) {o.RUN}" for k in (1, 2, 3)}]
_factor("f_today_vol", [Fd("today_volatility", intraday=("resid",))], {}, {"today_volatility": "CASE WHEN n > 1 THEN sqrt(s2 / (n - 1)) ELSE sqrt(s2) * 0.5 END"}, _DR)
_factor("f_today_skew", [Fd("today_skewness", intraday=("resid",))], {}, {"today_skewness": o.skew_adj("n", "s1", "s2", "s3")}, _DR)
_LV = [{"v": "ln(volume + 1)"}, {"n": f"CAST(count(v) {o.RUN} AS DOUBLE)", "sd": f"stddev_pop(v) {o.RUN}"} | {f"s{k}": f"sum({' * '.join(['v'] * k)}) {o.RUN}" for k in (1, 2, 3)}]
_factor("f_today_std", [Fd("today_std", intraday=("volume",))], {}, {"today_std": "sd"}, _LV)
_factor("f_today_logskew", [Fd("today_log_skewness", intraday=("volume",))], {}, {"today_log_skewness": o.skew_adj("n", "s1", "s2", "s3")}, _LV)
_factor(
    "f_today_position", [Fd("today_position", intraday=(MID, "high", "low"))], {}, {"today_position": f"CASE WHEN hi = lo OR {MID} = 0 THEN 0.5 ELSE ({MID} - lo) / (hi - lo) END"}, [{"hi": f"max(high) {o.RUN}", "lo": f"min(low) {o.RUN}"}]
)
_factor(
    "f_transform_id_abs_div",
    [_mom1, Fd("id", intraday=("resid_rank",)), Fd("abs", cache=("daily_mom_1",)), Fd("div", cache=("daily_mom_1",), intraday=("resid_rank",))],
    _Y1,
    {"id_resid_rank": "resid_rank", "abs_daily_mom_1": f"abs({o.MOM1})", "div": f"{_M1} / resid_rank"},
    keep=["id_resid_rank", "abs_daily_mom_1", "div"],
)
_factor("f_vacancy", [Fd("daily_recent_vacancy", w, daily=("adjusted_close",)) for w in (1, 3, 5)], {f"c{w}": f"count({o.AC}) {o.back(w)}" for w in (1, 3, 5)}, {f"daily_recent_vacancy_{w}": f"CASE WHEN c{w} / {w}.0 > 0.8 THEN 1 ELSE 0 END" for w in (1, 3, 5)})
_RD = "round_even(({p} / y - 1) * 100, 0) / 100"
_BOOK = (MID, "ask_volume1", "bid_volume1")


def _limit_sql(up: bool) -> str:
    at = " OR ".join(f"{_RD.format(p=MID)} = {x if up else -x}" for x in (0.05, 0.1, 0.2))
    return f"CASE WHEN y IS NOT NULL AND ({at}) AND {'ask_volume1 = 0 AND bid_volume1 > 0' if up else 'bid_volume1 = 0 AND ask_volume1 > 0'} THEN 1 ELSE 0 END"


for _n, _k, _sql in (("f_tradable", "is_tradable", f"1 - {_limit_sql(True)}"), ("f_up_limit", "is_up_limit", _limit_sql(True)), ("f_down_limit", "is_down_limit", _limit_sql(False))):
    _factor(_n, [Fd(_k, daily=("adjusted_close",), intraday=_BOOK)], _Y1, {_k: _sql})

# Targets
_BUY = f"CASE WHEN ask_price1 = 0 THEN {MID} ELSE ask_price1 END"
_factor(
    "t_future_day",
    [Fd("future_day_targets", w, future=("adjusted_close",), intraday=("ask_price1", MID)) for w in (3, 1, 0)],
    {f"c{w}": f"lead({o.AC}, {w}) {o.BY_DAY} * factor" for w in (3, 1, 0)},
    {f"future_day_targets_{w}": f"{L(f'c{w}')} - {L(_BUY)}" for w in (3, 1, 0)},
)
_factor("t_inter_day", [Fd("inter_day_targets", 1, future=("adjusted_close",), intraday=(MID,))], {"c1": f"lead({o.AC}, 1) {o.BY_DAY} * factor"}, {"inter_day_targets_1": f"{L('c1')} - {L('z')}"}, [{"z": f"last_value({MID}) {o.REST}"}])
_HL = {"h3": f"max(high / factor) {_AH} * factor", "l3": f"min(low / factor) {_AH} * factor"}
_factor("t_range", [Fd("future_day_range_targets", 3, future=("adjusted_high", "adjusted_low"))], _HL, {"future_day_range_targets_3": f"{L('h3')} - {L('l3')}"})
_factor("t_up_range", [Fd("future_day_up_range_targets", 3, future=("adjusted_high",), intraday=(MID,))], _HL, {"future_day_up_range_targets_3": f"{L('h3')} - {L(MID)}"})
_factor("t_down_range", [Fd("future_day_down_range_targets", 3, future=("adjusted_low",), intraday=(MID,))], _HL, {"future_day_down_range_targets_3": f"{L('l3')} - {L(MID)}"})
_factor(
    "t_today",
    [Fd("today_targets", 10, intraday=("ask_price1", "bid_price1", MID))],
    {},
    {"today_targets_10": f"{L('z')} - {L(_BUY)}"},
    [{"sp": f"CASE WHEN bid_price1 = 0 THEN {MID} ELSE bid_price1 END"}, {"z": f"coalesce(lead(sp, 10) {o.SLOT}, last_value(sp) {o.REST})"}],
)

# Groups: every factor of a group in one plan, all of them returned and compared.
for _g in groups.GROUPS:
    query("group_targets" if _g.endswith("with_range") else f"group_{_g}", o.group_sql(groups.group(_g)))(lambda s, d, g=_g: factors(s, d, groups.group(g), raw=False))

# Groups over half months, so that the windows of 63 and 126 days are full. Running sums of that length round off in
# another order in each engine: four decimals are compared.


def _long(s: SparkSession, d: str, g: str) -> DataFrame:
    made = compile_factors(groups.group(g), bars.dense_daily(bars.long_daily_panel(s, d)), bars.long_intraday_spans(s, d), bars.LONG_SLOTS)
    return made.select(*[nearest(F.col(c), 4).alias(c) if kind == "double" else c for c, kind in made.dtypes])


for _g in ("default", "fg260114"):
    query(f"group_{_g}_long", o.long_group_sql(groups.group(_g)))(lambda s, d, g=_g: _long(s, d, g))

# Whole lists with the ranks of every factor, after one exchange by cross-section.
for _g in ("lib", "fg260114"):
    query(f"group_{_g}_ranked", o.ranked_group_sql(groups.group(_g)))(lambda s, d, g=_g: factors(s, d, groups.group(g), raw=False, ranks=True))

# Ranks ------------------------------------------------------------------------------------------

query("rank_binned_pop", o.binned(o.DAILY, "daily", "close", "date", 2000, 3.5, False, KEY))(lambda s, d: xs.binned_percentile(daily(s, d).select(*KEY, "close"), "close", ["date"], 2000, 3.5).select(*KEY, "rank"))
query("rank_binned_samp", o.binned(o.DAILY, "daily", "close", "date", 1000, 3.5, True, KEY))(lambda s, d: xs.binned_percentile(daily(s, d).select(*KEY, "close"), "close", ["date"], 1000, 3.5, sample_std=True).select(*KEY, "rank"))
query("rank_exact", o.pick(f"{o.DAILY}, x AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY date) AS n FROM daily)", "x", KEY, {"rank": "(r - 0.5) / n"}))(
    lambda s, d: xs.exact_percentile(daily(s, d).select(*KEY, "close"), "close", ["date"]).select(*KEY, "rank")
)


_RANKED = [o.binned(o.DAILY, "daily", c, "date", 2000, 3.5, False, KEY, f"rank_{c}", "4 * ({}) - 2") for c in ("volume", "close")]


@query("rank_factors", f"SELECT * FROM ({_RANKED[0]}) JOIN ({_RANKED[1]}) USING (date, instrument)")
def _rank_factors(s, d):
    return xs.ranked_columns(daily(s, d).select(*KEY, "volume", "close"), ["volume", "close"], ["date"]).select(*KEY, "rank_volume", "rank_close")


# Cross-sections and evaluation --------------------------------------------------------------------

_D = ["date"]
query("xs_ic", f"WITH {o.PRED}, a AS (SELECT date, count(*) AS n, corr(pred, gt_1) AS c FROM pairs GROUP BY date) SELECT d.date, coalesce(n, 0) AS n, round(CASE WHEN n >= 20 THEN c END, 6) + 0.0 AS ic FROM (SELECT DISTINCT date FROM pred) d LEFT JOIN a USING (date)")(lambda s, d: xs.ic(pred(s, d), "pred", "gt_1", _D))
_RK = "rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) AS p, row_number() OVER (PARTITION BY date ORDER BY gt_1, instrument) AS g, row_number() OVER (PARTITION BY date ORDER BY pred DESC, instrument) AS t, count(*) OVER (PARTITION BY date) AS n FROM pairs)"
query("xs_rankic", f"WITH {o.PRED}, {_RK} SELECT date, n, round(corr(p, g) * (n - 1) / n, 6) + 0.0 AS rank_ic FROM rk GROUP BY date, n")(lambda s, d: xs.rank_ic(pred(s, d), "pred", "gt_1", _D))
query("xs_long_rank_ic", f"WITH {o.PRED}, {_RK}, h AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) AS p, row_number() OVER (PARTITION BY date ORDER BY gt_1, instrument) AS g FROM rk WHERE t <= floor(n * 0.5)), a AS (SELECT date, count(*) AS k, corr(p, g) * (count(*) - 1) / count(*) AS c FROM h GROUP BY date) SELECT d.date, coalesce(k, 0) AS k, round(coalesce(CASE WHEN k >= 2 THEN c END, 0), 6) + 0.0 AS long_ic FROM (SELECT DISTINCT date FROM pred) d LEFT JOIN a USING (date)")(
    lambda s, d: xs.long_rank_ic(pred(s, d), "pred", "gt_1", _D)
)
query("xs_long_ic", f"WITH {o.PRED}, q AS (SELECT *, quantile_cont(pred, 0.5) OVER (PARTITION BY date) AS q FROM pairs), a AS (SELECT date, count(*) AS n, corr(pred, gt_1) AS c FROM q WHERE pred >= q GROUP BY date) SELECT date, n, round(CASE WHEN n >= 20 THEN c END, 6) + 0.0 AS ic FROM a")(lambda s, d: xs.long_ic(pred(s, d), "pred", "gt_1", _D, 0.5))
query("xs_hit", f"WITH {o.PRED}, q AS (SELECT *, quantile_cont(pred, 0.5) OVER (PARTITION BY date) AS q FROM pairs) SELECT date, round(avg(CASE WHEN (pred > q) = (gt_1 > 0) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate FROM q GROUP BY date")(lambda s, d: xs.hit_rate(pred(s, d), "pred", "gt_1", _D))
query("xs_auc", f"WITH {o.PRED}, r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2.0 AS r FROM pairs), a AS (SELECT date, count(*) AS n, sum(r) FILTER (WHERE gt_1 > 0) AS r, count(*) FILTER (WHERE gt_1 > 0) AS p FROM r GROUP BY date) SELECT date, n, round(CASE WHEN n >= 20 AND p > 0 AND p < n THEN (r - p * (p + 1) / 2.0) / (p * (n - p)) END, 6) + 0.0 AS auc FROM a")(
    lambda s, d: xs.auc(pred(s, d), "pred", "gt_1", _D)
)
_BK = "bk AS (SELECT date, gt_1, CAST(floor((p * 5.0 - 1) / n) AS BIGINT) AS bucket FROM rk WHERE n >= 50)"
query("xs_quantile_stats", f"WITH {o.PRED}, {_RK}, {_BK} SELECT date, bucket, count(*) AS n, round(avg(gt_1), 6) + 0.0 AS mean FROM bk GROUP BY date, bucket")(lambda s, d: xs.quantile_stats(pred(s, d), "pred", "gt_1", _D, 5))
query(
    "xs_quantile_summary",
    f"WITH {o.PRED}, {_RK}, {_BK}, m AS (SELECT date, bucket, avg(gt_1) AS mean FROM bk GROUP BY 1, 2), mr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mean, bucket) AS r FROM m), "
    "b AS (SELECT date, arg_max(mean, bucket) - arg_min(mean, bucket) AS spread, corr(bucket, r) AS monotonicity FROM mr GROUP BY date), "
    "t AS (SELECT date, avg(gt_1) FILTER (WHERE t <= greatest(1, round(n * 0.01))) - avg(gt_1) FILTER (WHERE p <= greatest(1, round(n * 0.01))) AS tail, avg(gt_1) FILTER (WHERE t <= 5) AS top_5, avg(gt_1) FILTER (WHERE t <= 10) AS top_10 FROM rk WHERE n >= 50 GROUP BY date) "
    "SELECT date, round(spread, 6) + 0.0 AS spread, round(monotonicity, 6) + 0.0 AS monotonicity, round(tail, 6) + 0.0 AS tail, round(top_5, 6) + 0.0 AS top_5, round(top_10, 6) + 0.0 AS top_10 FROM b JOIN t USING (date)",
)(lambda s, d: xs.quantile_summary(pred(s, d), "pred", "gt_1", _D, 5))
_EDGES = (-2.0, -1.0, 0.0, 1.0, 2.0)
query("xs_value_buckets", f"WITH {o.PRED}, z AS (SELECT date, gt_1, CASE WHEN stddev_pop(pred) OVER (PARTITION BY date) > 0 THEN (pred - avg(pred) OVER (PARTITION BY date)) / stddev_pop(pred) OVER (PARTITION BY date) END AS z FROM pairs) SELECT date, CAST({' + '.join(f'(z >= {e})::BIGINT' for e in _EDGES)} AS BIGINT) AS bucket, count(*) AS n, round(avg(gt_1), 6) + 0.0 AS mean FROM z WHERE z IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: xs.value_buckets(pred(s, d), "pred", "gt_1", _D, _EDGES)
)
_TOP = "coalesce(avg(gt_1) FILTER (WHERE {c} <= floor(n * 0.1)), 0)"
query("xs_tiered", f"WITH {o.PRED}, {_RK} SELECT date, round({_TOP.format(c='t')}, 6) + 0.0 AS top, round({_TOP.format(c='p')}, 6) + 0.0 AS bottom, round({_TOP.format(c='t')} - {_TOP.format(c='p')}, 6) + 0.0 AS spread FROM rk GROUP BY date")(lambda s, d: xs.tiered_returns(pred(s, d), "pred", "gt_1", _D))
query("xs_precision", f"WITH {o.PRED}, {_RK} SELECT date, round(coalesce(avg(CASE WHEN gt_1 > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE t <= floor(n * 0.1)), 0), 6) + 0.0 AS precision FROM rk GROUP BY date")(lambda s, d: xs.precision(pred(s, d), "pred", "gt_1", _D))
query("xs_coverage", f"WITH {o.PRED} SELECT date, round(avg(CASE WHEN gt_1 < abs(pred) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS coverage, round(avg(abs(pred)), 6) + 0.0 AS interval_width FROM pairs GROUP BY date")(lambda s, d: xs.coverage(pred(s, d), "pred", "gt_1", _D))


@query("xs_metric_table", f"WITH {o.PRED}, {_RK} SELECT date, round(corr(p, g) * (n - 1) / n, 6) + 0.0 AS day_ic_gt_1, round({_TOP.format(c='t')} - {_TOP.format(c='p')}, 6) + 0.0 AS day_tiered_returns_gt_1 FROM rk GROUP BY date, n")
def _metric_table(s, d):
    return ev.metric_table(pred(s, d), [("day", "pred", ["gt_1"], ["ic", "tiered_returns"])], _D)


def _metrics_sql(source: str, horizons: list[str], by: list[str], least: int, q: int, tops: tuple[int, ...]) -> str:
    """Two table expressions: cs, every metric of each cross-section, and ev, their averages by date and horizon."""
    g, keys = ", ".join([*by, "horizon"]), ", ".join(by)
    long = " UNION ALL ".join(f"SELECT {keys}, instrument, pred AS p, '{h}' AS horizon, {h} AS g FROM {source}" for h in horizons)
    tied = lambda c, part: f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0 END"
    mean = lambda c: f"avg(g) FILTER (WHERE ok AND {c})"
    corr = lambda x, y, c: f"CASE WHEN count(*) FILTER (WHERE {c}) >= {least} THEN nullif(corr({x}, {y}) FILTER (WHERE {c}), 'nan'::DOUBLE) END"
    enough = f"max(n) >= {max(50, 5 * q)}"
    pos = "count(*) FILTER (WHERE ok AND g > 0)"
    returns = [mean(f"floor(((k + 1) * {q} - 1) / n) = {i}") for i in range(q)] + [mean(f"k >= n - {c}") for c in tops]
    rank = lambda i: " + ".join(["0.5", *[f"(b{j} < b{i})::INT + (b{j} = b{i})::INT * 0.5" for j in range(q)]])
    centred = {i: f"({rank(i)} - {(q + 1) / 2})" for i in range(q)}
    mono = f"({' + '.join(f'{i + 1 - (q + 1) / 2} * {centred[i]}' for i in range(q))}) / nullif(sqrt({sum((i + 1 - (q + 1) / 2) ** 2 for i in range(q))} * ({' + '.join(f'{centred[i]} * {centred[i]}' for i in range(q))})), 0)"
    return f"""lg AS ({long}),
rk1 AS (SELECT *, {tied('p', g)} AS rp, {tied('g', g)} AS rg, coalesce(p IS NOT NULL AND g IS NOT NULL, false) AS ok FROM lg),
rk2 AS (SELECT *, quantile_cont(rp, 0.5) OVER (PARTITION BY {g}) AS m, quantile_cont(p, 0.5) OVER (PARTITION BY date, horizon) AS t, count(*) FILTER (WHERE ok) OVER (PARTITION BY {g}) AS n,
  row_number() OVER (PARTITION BY {g}, ok ORDER BY p, instrument) - 1 AS k, {tied('p', f'{g}, ok')} AS ru FROM rk1),
cs0 AS (SELECT {g}, max(n) AS n, {corr('p', 'g', 'ok')} AS ic, {corr('rp', 'rg', 'ok')} AS rank_ic, {corr('rp', 'rg', 'ok AND rp >= m')} AS rank_ic_long, -{corr('rp', 'rg', 'ok AND rp <= m').replace('CASE', '(CASE', 1)}) AS rank_ic_short,
  CASE WHEN max(n) >= {least} THEN avg(((p > t) = (g > 0))::INT) FILTER (WHERE ok) END AS hit_rate,
  CASE WHEN max(n) >= 20 AND {pos} > 0 AND {pos} < max(n) THEN (sum(ru) FILTER (WHERE ok AND g > 0) - {pos} * ({pos} + 1) / 2.0) / ({pos} * (max(n) - {pos})) END AS auc,
  CASE WHEN {enough} THEN {mean('k >= n - greatest(1, round_even(0.01 * n, 0))')} - {mean('k < greatest(1, round_even(0.01 * n, 0))')} END AS tail,
  {', '.join(f'CASE WHEN {enough} THEN {x} END AS b{i}' for i, x in enumerate(returns))} FROM rk2 GROUP BY {g}),
cs AS (SELECT *, b{q + len(tops) - 1} AS top, b0 AS bottom, b{q - 1} - b0 AS spread, CASE WHEN b0 IS NOT NULL THEN {mono} END AS monotonicity FROM cs0),
ev AS (SELECT date, horizon, {', '.join(f'avg({m}) AS {m}' for m in ev.DAILY)}, {', '.join(f'avg(b{i}) AS b{i}' for i in range(q + len(tops)))} FROM cs GROUP BY date, horizon)"""


_HS, _MS = ["gt_1", "gt_2", "gt_3"], list(ev.DAILY)
_QT = {"q": 5, "tops": (5, 10)}
_EV = f"{o.PRED},\n{_metrics_sql('pred', _HS, ['date'], 20, 5, (5, 10))}"
_BS = {f"return_{i}": f"b{i}" for i in range(7)}


def _spread_out(df: DataFrame) -> DataFrame:
    return df.select("date", "horizon", *_MS, *[F.get("quantile_returns", F.lit(i)).alias(n) for i, n in enumerate(_BS)])


def _daily_metrics(s, d):
    return ev.daily_metrics(pred(s, d), "pred", _HS, **_QT)


query("eval_daily", o.pick(_EV, "ev", ["date", "horizon"], {m: m for m in _MS} | _BS))(lambda s, d: _spread_out(_daily_metrics(s, d)))
_SLOTTED = f"{o.EVENTS},\n{o.INTRA},\nsl AS (SELECT date, slot, instrument, resid AS pred, {o.ln(f'coalesce(lead(mid_price, 3) {o.SLOT}, last_value(mid_price) {o.REST})')} - {o.ln('mid_price')} AS r3, {o.ln(f'last_value(mid_price) {o.REST}')} - {o.ln('mid_price')} AS rc FROM intra),\n{_metrics_sql('sl', ['r3', 'rc'], ['date', 'slot'], 20, 5, (5, 10))}"


@query("eval_slots", o.pick(_SLOTTED, "ev", ["date", "horizon"], {m: m for m in _MS} | _BS))
def _eval_slots(s, d):
    """Cross-sections of every slot, averaged to days."""
    rows = intra(s, d).select(*SLOTKEY, F.col("resid").alias("pred"), wd.return_ahead("mid_price", 3).alias("r3"), wd.return_ahead("mid_price", -1).alias("rc"))
    return _spread_out(ev.daily_metrics(rows, "pred", ["r3", "rc"], slot="slot", **_QT))


_SUMMED = f"SELECT horizon, count(*) AS n_days, {', '.join(f'round(avg({m}), 6) + 0.0 AS {m}_mean, round(stddev_samp({m}), 6) + 0.0 AS {m}_std' for m in _MS)} FROM ev GROUP BY horizon"
query("eval_summary", f"WITH {_EV} {_SUMMED}")(lambda s, d: ev.summary(_daily_metrics(s, d), _MS))
_PEAKED = ["ic", "rank_ic", "rank_ic_long"]
query("eval_peak_horizon", f"WITH {_EV}, sm AS (SELECT horizon, {', '.join(f'abs(avg({m})) AS {m}' for m in _PEAKED)} FROM ev GROUP BY horizon) SELECT {', '.join(f'arg_max(horizon, {m}) AS {m}_peak' for m in _PEAKED)} FROM sm")(
    lambda s, d: ev.peak_horizon(ev.summary(_daily_metrics(s, d), _PEAKED), _PEAKED)
)
query("eval_top_horizons", f"WITH {_EV}, sm AS (SELECT horizon, abs(avg(rank_ic)) AS m FROM ev GROUP BY horizon) SELECT row_number() OVER (ORDER BY m DESC, horizon) AS rank, horizon FROM sm QUALIFY rank <= 2")(
    lambda s, d: ev.top_horizons(ev.summary(_daily_metrics(s, d), _PEAKED), "rank_ic", 2)
)


@query("eval_cumulative", f"WITH {o.PRED}, {_RK}, t AS (SELECT date, ({_TOP.format(c='t')} - {_TOP.format(c='p')}) / 100 AS spread FROM rk GROUP BY date) SELECT 'gt_1' AS horizon, date, round(avg(spread) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS mean_so_far, round(exp(sum(ln(1 + spread)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS equity FROM t")
def _cumulative(s, d):
    t = xs.tiered_returns(pred(s, d), "pred", "gt_1", _D).select("date", (F.col("spread") / 100).alias("spread"), F.lit("gt_1").alias("horizon"))
    return ev.cumulative(t, "spread")


_P = "(rank() OVER (PARTITION BY date ORDER BY pred) + (count(*) OVER (PARTITION BY date, pred) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date)"
_BIN = f"CASE WHEN p < 0.99 THEN floor(p * 100) ELSE 99 {' '.join(f'+ (p >= {e})::INT' for e in xs.TAIL_EDGES)} END"


@query(
    "global_quantile_bins",
    f"WITH {o.PRED}, q AS (SELECT *, {_P} AS p FROM pred WHERE pred IS NOT NULL), l AS ({' UNION ALL '.join(f'''SELECT 'gt_{h}' AS horizon, p, gt_{h} AS v FROM q''' for h in (1, 2, 3))}) "
    f"SELECT horizon, CAST({_BIN} AS BIGINT) AS bin, count(*) AS n, round(sum(v), 6) + 0.0 AS total, round(avg(v), 6) + 0.0 AS mean FROM l WHERE v IS NOT NULL GROUP BY 1, 2",
)
def _bins(s, d):
    p = xs.exact_percentile(pred(s, d).where("pred IS NOT NULL"), "pred", _D, "p")
    return xs.quantile_accumulator(p, "p", ["gt_1", "gt_2", "gt_3"])


@query(
    "newey_west",
    f"WITH {o.PRED}, {_RK}, s AS (SELECT date, corr(p, g) AS x FROM rk GROUP BY date), c AS (SELECT date, x, x - avg(x) OVER () AS c FROM s WHERE x IS NOT NULL), "
    f"l AS (SELECT x, c, {', '.join(f'lag(c, {j}) OVER (ORDER BY date) AS c{j}' for j in (1, 2, 3))} FROM c), a AS (SELECT count(*) AS n, avg(x) AS mean, (sum(c * c) {' '.join(f'+ 2 * {1 - j / 4} * coalesce(sum(c * c{j}), 0)' for j in (1, 2, 3))}) / count(*) AS v FROM l) "
    "SELECT n, round(mean, 6) + 0.0 AS mean, round(CASE WHEN n >= 10 AND v > 0 THEN mean / sqrt(v / n) END, 6) + 0.0 AS t FROM a",
)
def _newey(s, d):
    return xs.newey_west(xs.rank_ic(pred(s, d), "pred", "gt_1", _D, scaled=False), "rank_ic", "date", 3)


# Neutralisation on the monthly panel ---------------------------------------------------------------


@query("neutralize_1f", o.pick(f"{o.MONTH}, x AS (SELECT date, instrument, alpha, daily_return, count(*) OVER w AS n, regr_slope(daily_return, alpha) OVER w AS b, regr_intercept(daily_return, alpha) OVER w AS a FROM month WINDOW w AS (PARTITION BY date))", "x", KEY, {"beta_alpha": "b", "residual": "daily_return - (a + b * alpha)"}, "WHERE n >= 20"))
def _neutral(s, d):
    return xs.neutralize(bars.month_panel(s, d), "daily_return", ["alpha"], ["date"], least=20).select(*KEY, "beta_alpha", "residual")


_CEN = ", ".join(f"{x} - avg({x}) OVER (PARTITION BY date) AS d{i}" for i, x in enumerate(("daily_return", "alpha", "high")))


@query(
    "neutralize_2f",
    o.pick(
        f"{o.MONTH}, c AS (SELECT date, instrument, {_CEN}, count(*) OVER (PARTITION BY date) AS n FROM month), "
        f"f AS (SELECT date, {', '.join(f'sum(d{i} * d{j}) AS s{i}{j}' for i in range(3) for j in range(i, 3))} FROM c GROUP BY date), "
        "b AS (SELECT date, (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) AS b1, (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM f WHERE s11 * s22 - s12 * s12 <> 0)",
        "c JOIN b USING (date)", KEY, {"residual": "d0 - b1 * d1 - b2 * d2"}, "WHERE n >= 20",
    ),
)
def _neutral2(s, d):
    return xs.neutralize(bars.month_panel(s, d), "daily_return", ["alpha", "high"], ["date"], least=20).select(*KEY, "residual")


# Three regressors by taking one after the other out of the rest; a month on which they can't be told apart is left out.
def _out(of: list[str], x: str) -> str:
    return ", ".join(f"{c} - coalesce(regr_slope({c}, {x}) OVER (PARTITION BY date), 0) * ({x} - avg({x}) OVER (PARTITION BY date)) - avg({c}) OVER (PARTITION BY date) AS {c}" for c in of)


@query(
    "neutralize_3f",
    o.pick(
        f"{o.MONTH}, z0 AS (SELECT date, instrument, daily_return AS y, alpha AS a, high AS b, volume / 100.0 AS c, count(*) OVER (PARTITION BY date) AS n FROM month), "
        f"z1 AS (SELECT date, instrument, n, {_out(['y', 'b', 'c'], 'a')} FROM z0), z2 AS (SELECT date, instrument, n, {_out(['y', 'c'], 'b')} FROM z1), z3 AS (SELECT date, instrument, n, {_out(['y'], 'c')} FROM z2)",
        "z3", KEY, {"residual": "y"}, "WHERE n >= 20",
    ),
)
def _neutral3(s, d):
    panel = bars.month_panel(s, d).withColumn("c", F.col("volume") / 100)
    return xs.neutralize(panel, "daily_return", ["alpha", "high", "c"], ["date"], least=20).select(*KEY, "residual")


query("betas", o.pick(f"{o.MONTH}", "(SELECT date, count(*) AS n, regr_intercept(daily_return, alpha) AS i, regr_slope(daily_return, alpha) AS b, corr(daily_return, alpha) AS c FROM month GROUP BY date)", ["date", "n"], {"intercept": "i", "beta_alpha": "b", "corr_alpha": "c"}, "WHERE n >= 20"))(
    lambda s, d: xs.betas(bars.month_panel(s, d), "daily_return", ["alpha"], ["date"], least=20)
)


# Sketches, profiles, losses, sampling, models, streams ------------------------------------------------

_TL = (0.9, 0.99, 0.999)


@query("exact_tail", " UNION ALL ".join(f"SELECT '{c}' AS horizon, CAST({x} AS DOUBLE) AS level, round(quantile_cont({c}, {x}), 6) + 0.0 AS upper, round(quantile_cont({c}, {round(1 - x, 6)}), 6) + 0.0 AS lower FROM lineitem" for c in ("l_quantity", "l_extendedprice") for x in _TL))
def _exact_tail(s, d):
    return ev.exact_tails(bars.read(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], _TL)


# Sketches: what they return depends on how rows were dealt, so it is their rank in the exact distribution that is compared, to hundredths.
_RANKS = " UNION ALL ".join(f"SELECT '{c}' AS horizon, CAST({x} AS DOUBLE) AS level, CAST(round({x}, 2) AS DOUBLE) AS upper_rank, CAST(round({1 - x}, 2) AS DOUBLE) AS lower_rank" for c in ("l_extendedprice",) for x in _TL)


@query("sketch_tail", _RANKS)
def _tail(s, d):
    """Both tails from a sketch merged of the months' sketches, and the exact ranks of its quantiles."""
    line = bars.read(s, d, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    months = ev.quantile_sketches(line, ["l_extendedprice"], 4096, by=["month"])
    got = ev.sketch_quantiles(ev.merged(months), _TL)
    both = line.crossJoin(F.broadcast(got)).groupBy("horizon", "level")  # a row for each level
    rank = lambda c: F.round(F.avg((F.col("l_extendedprice") <= F.col(c)).cast("double")), 2)
    return both.agg(rank("upper").alias("upper_rank"), rank("lower").alias("lower_rank"))


_POINTS = (10000.0, 30000.0, 60000.0)


@query("sketch_cdf", f"SELECT 'l_extendedprice' AS horizon, CAST(x AS DOUBLE) AS x, round((SELECT avg((l_extendedprice <= x)::INT) FROM lineitem), 2) + 0.0 AS cdf FROM (VALUES {', '.join(f'({p})' for p in _POINTS)}) t(x)")
def _cdf(s, d):
    return ev.sketch_ranks(ev.quantile_sketches(bars.read(s, d, "lineitem"), ["l_extendedprice"], 4096), _POINTS).withColumn("cdf", F.round("cdf", 2))


@query(
    "vol_profile_ewma",
    f"WITH {o.EVENTS},\n{o.INTRA}, c AS (SELECT date, instrument, slot, sum(volume) {o.RUN} / sum(volume) OVER (PARTITION BY instrument, date) AS share FROM intra), k AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY instrument, slot) - 1 AS last FROM c WHERE slot % 6 = 5 WINDOW w AS (PARTITION BY instrument, slot ORDER BY date)) "
    "SELECT instrument, slot, round(sum(CASE WHEN k = 0 THEN pow(0.95, last) * share ELSE 0.05 * pow(0.95, last - k) * share END), 6) + 0.0 AS profile FROM k GROUP BY instrument, slot",
)
def _profile(s, d):
    """Each instrument's cumulative volume share at sampled slots, averaged over days with decay 0.95: the last day's weights in closed form."""
    w = Window.partitionBy("instrument", "date")
    share = intra(s, d).withColumn("share", wd.total("volume") / F.sum("volume").over(w)).where("slot % 6 = 5")
    by = Window.partitionBy("instrument", "slot")
    k = share.select("instrument", "slot", "share", (F.row_number().over(by.orderBy("date")) - 1).alias("k"), (F.count("*").over(by) - 1).alias("last"))
    decayed = F.pow(F.lit(0.95), F.col("last") - F.col("k"))
    return k.groupBy("instrument", "slot").agg(F.sum(F.when(F.col("k") == 0, decayed).otherwise(0.05 * decayed) * F.col("share")).alias("profile"))


_PW = "FROM pairs a JOIN pairs b ON a.date = b.date AND a.instrument < b.instrument"


@query("pairwise_loss", f"WITH {o.PRED} SELECT a.date, count(*) AS pairs, round(sum(greatest(a.pred - b.pred, 0) + ln(1 + exp(-abs(a.pred - b.pred))) - (a.pred - b.pred) * (a.gt_1 - b.gt_1 > 0.001)::INT) / (count(*) + 1e-8), 6) + 0.0 AS loss {_PW} GROUP BY a.date")
def _pairwise(s, d):
    return xs.pair_loss(pred(s, d), "pred", "gt_1", ["date"])


#: Sequences are instruments, their steps a day's slots; the mask leaves out slots without trades.
_SEQ = f"WITH {o.DENSE},\n{o.INTRA}, q AS (SELECT date, instrument, slot, {L(MID)} - {L(f'first_value({MID}) {o.RUN}')} AS p, {L(f'last_value({MID}) {o.REST}')} - {L(MID)} AS g, volume AS m FROM intra)"


@query("sequence_pair_loss", f"{_SEQ} SELECT a.date, count(*) AS pairs, round(sum(greatest(a.p - b.p, 0) + ln(1 + exp(-abs(a.p - b.p))) - (a.p - b.p) * (a.g - b.g > 0.001)::INT) / (count(*) + 1e-8), 6) + 0.0 AS loss FROM q a JOIN q b ON a.date = b.date AND a.slot = b.slot AND a.instrument < b.instrument WHERE a.m > 0 AND b.m > 0 GROUP BY a.date")
def _sequence_pairs(s, d):
    q = intra(s, d).select(*SLOTKEY, (ln(MID) - ln(wd.opening(MID))).alias("p"), wd.return_ahead(MID, -1).alias("g"), F.col("volume").alias("m"))
    return xs.sequence_pair_loss(q, "p", "g", "m", ["date"], "slot")


@query("losses", f"WITH {o.PRED} SELECT date, round(avg(abs(pred - gt_1)), 6) + 0.0 AS mae_pred_gt_1, round(avg((pred - gt_1) * (pred - gt_1)), 6) + 0.0 AS mse_pred_gt_1, round(0.5 * avg(abs(pred - gt_1)) + 2 * avg((pred - gt_1) * (pred - gt_1)), 6) + 0.0 AS total FROM pairs GROUP BY date")
def _losses(s, d):
    return mlp.hybrid(pred(s, d), [("mae", "pred", "gt_1", 0.5), ("mse", "pred", "gt_1", 2.0)], _D)


@query("time_embedding", "SELECT DISTINCT CAST(hour(ts) AS BIGINT) AS slot, round(sin(hour(ts)), 6) + 0.0 AS s0, round(cos(hour(ts) * exp(-2 * ln(500) / 4)), 6) + 0.0 AS c2 FROM events")
def _embedding(s, d):
    e = mlp.time_embedding(F.col("slot").cast("double"), 4)
    return bars.events(s, d).select(F.hour("ts").alias("slot")).distinct().select("slot", F.get(e, F.lit(0)).alias("s0"), F.get(e, F.lit(3)).alias("c2"))


_WIDE = mlp.init_weights(64, 4, gated=True)


def _wide_sql() -> str:
    n = o.NetworkSql(f"SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(64))} FROM embeddings WHERE len(embedding) = 64", ["vec_id"])
    out = n.network(_WIDE, [f"x{i}" for i in range(64)], "0")
    return o.pick(", ".join(n.steps), n.last, ["vec_id"], {f"pred_{i}": out[i] for i in (0, 2)})


@query("infer_mlp", _wide_sql())
def _infer(s, d):
    """A network of two gated blocks over embeddings, two of its outputs."""
    v = bars.read(s, d, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    return mlp.predict(v, "embedding", _WIDE, ["vec_id"], outputs=[0, 2])


@query("timing_stats", "SELECT event_type AS label, event_id, round(value, 6) + 0.0 AS seconds, round(avg(value) OVER w, 6) + 0.0 AS mean, round(stddev_samp(value) OVER w, 6) + 0.0 AS std, round(1.96 * stddev_samp(value) OVER w / sqrt(count(value) OVER w), 6) + 0.0 AS half_width FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _timings(s, d):
    e = bars.read(s, d, "events").select(F.col("event_type").alias("label"), "event_id", F.col("value").alias("seconds"))
    return ev.timing_stats(e, "label", "seconds", "event_id")


@query("factor_summary", o.pick(f"{o.DENSE},\n{o.INTRA}, x AS (SELECT {L(MID)} - {L('c')} AS v FROM intra i JOIN (SELECT date, instrument, lag({o.AC}) {o.BY_DAY} * factor AS c FROM dense) d USING (date, instrument))", "(SELECT 'daily_mom_1' AS factor, count(*) - count(v) AS missing, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS least, max(v) AS most FROM x)", ["factor", "missing"], ["mean", "std", "least", "most"]))
def _factor_summary(s, d):
    f = factors(s, d, [_mom1])
    v = "daily_mom_1"
    return f.agg(F.lit(v).alias("factor"), F.count_if(F.col(v).isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))


# Training items and inference


_ITEM = {"features": [_mom1, Fd("daily_mom", 5, daily=("adjusted_close",), intraday=(MID,), scale=50)], "targets": [Fd("future_day_targets", 1, future=("adjusted_close",), intraday=("ask_price1", MID))], "filters": groups.group("filters")}
_ITEM_SQL = o.group_sql([d for part in _ITEM.values() for d in part])
_FILTERED = " AND ".join(f"{d.name} > 0" for d in _ITEM["filters"])


@query("dataset_item", f"SELECT date, instrument, slot, daily_mom_1, daily_mom_5, future_day_targets_1, coalesce({_FILTERED}, false) AS selector FROM ({_ITEM_SQL})")
def _item(s, d):
    return datasets.DATASETS["intraday_cs"](dense(s, d), intra(s, d), **_ITEM, slots=SLOTS)


@query("dataset_sample", f"SELECT date, count(*) AS kept, count(*) AS chosen FROM (SELECT date, instrument FROM ({_ITEM_SQL}) WHERE slot >= 6 AND slot < 18 GROUP BY 1, 2 HAVING bool_and(coalesce({_FILTERED}, false))) GROUP BY date")
def _item_sample(s, d):
    """Draws of the instruments all of whose slots are selected: none of them may be lost."""
    items = _item(s, d)
    drawn = datasets.COLLATES["sample"](items, 3, (6, 18)).select(*KEY, F.lit(1).alias("one"))
    sure = items.where("slot >= 6 AND slot < 18").groupBy(*KEY).agg(F.every("selector").alias("sure")).where("sure")
    return sure.join(drawn, KEY, "left").groupBy("date").agg(F.count("one").alias("kept"), F.count("*").alias("chosen"))


def _linear(w) -> list[str]:
    """SQL of the outputs of a network without blocks."""
    hidden = [" + ".join([f"{float(w['in'][0][i, j])!r} * {d.name}" for i, d in enumerate(_ITEM["features"])]) for j in range(len(w["in"][1]))]
    return [" + ".join(f"{float(w['out'][0][j, k])!r} * ({h})" for j, h in enumerate(hidden)) for k in range(len(w["out"][1]))]


_NET = mlp.init_weights(2, 3, hidden=4, blocks=0)


@query("factor_inference", f"SELECT date, instrument, slot, {', '.join(f'round({x}, 6) + 0.0 AS pred_{k}' for k, x in enumerate(_linear(_NET)))} FROM ({o.group_sql(_ITEM['features']).replace('round(CAST(', '(CAST(').replace(' AS DOUBLE), 6) + 0.0', ' AS DOUBLE))')})")
def _factor_inference(s, d):
    return datasets.infer(_ITEM["features"], _NET, dense(s, d), intra(s, d), SLOTS)


# Streams, drained into the shared folder


def _streams(s: SparkSession) -> str:
    from uuid import uuid4

    return f"{shared_folder(s)}/stream-{uuid4().hex}"


_RAW = {"n": "CAST(count(*) AS DOUBLE)"} | {f"s{k}": f"sum({' * '.join(['value'] * k)})" for k in (1, 2, 3)}


@query(
    "stream_running",
    f"WITH g AS (SELECT CAST(ts AS DATE) AS date, user_id AS instrument, {', '.join(f'{x} AS {n}' for n, x in _RAW.items())}, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2) "
    f"SELECT date, instrument, CAST(n AS BIGINT) AS n, round(s1, 6) + 0.0 AS total, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(sqrt(greatest(s2 / n - pow(s1 / n, 2), 0)), 6) + 0.0 AS std, round({o.skew_adj('n', 's1', 's2', 's3')}, 6) + 0.0 AS skewness FROM g",
)
def _stream(s, d):
    """A file stream in update mode; the last state of each key."""
    return running.run_to_table(running.running_day(running.event_stream(s, d)), _streams(s), "running", "update", ("date", "instrument"))


@query("stream_sketches", " UNION ALL ".join(f"SELECT CAST(ts AS DATE) AS date, 'value' AS horizon, CAST({x} AS DOUBLE) AS level, round(quantile_disc(value, {x}), 6) + 0.0 AS upper, round(quantile_disc(value, {1 - x}), 6) + 0.0 AS lower FROM events GROUP BY 1" for x in (0.75, 0.875)))
def _stream_sketches(s, d):
    """Quantiles of each day: streamed sketches bracket them, a second stream counts the values between and settles them exactly."""
    top, keys, uppers = _streams(s), ("date", "horizon"), (0.75, 0.875)
    sketches = running.run_to_table(running.day_sketches(running.event_stream(s, d), k=4096), top, "sketches", "update", keys)
    q = running.exact_quantiles(lambda: running.event_stream(s, d), sketches, [*uppers, *(1 - x for x in uppers)], top)
    tails = F.array(*[F.struct(F.lit(x).alias("level"), F.get("q", F.lit(i)).alias("upper"), F.get("q", F.lit(i + len(uppers))).alias("lower")) for i, x in enumerate(uppers)])
    return q.select(*keys, F.explode(tails).alias("t")).select(*keys, "t.*")


@query("stream_ewma", ORACLES["vol_profile_ewma"])
def _stream_ewma(s, d):
    """The volume profile as streamed state: the days arrive in three parts, with a restart before each but the first."""
    w = Window.partitionBy("instrument", "date")
    share = intra(s, d).withColumn("share", wd.total("volume") / F.sum("volume").over(w)).where("slot % 6 = 5").select("date", "instrument", "slot", "share")
    top = _streams(s)
    for a, b in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-12-31")):
        pn.between(share, a, b).write.mode("append").parquet(f"{top}/share")
        out = running.run_to_table(running.decayed(running.file_stream(s, f"{top}/share", None), "share", 0.95, ("instrument", "slot")), top, "profile", "update", ("instrument", "slot"))
    return out.select("instrument", "slot", F.col("ewma").alias("profile"))


@query("stream_factors", ORACLES["f_daily_mom"])
def _stream_factors(s, d):
    """A factor online: bars as a stream against the history that was there before the day."""
    top = _streams(s)
    intra(s, d).select(*SLOTKEY, MID).write.parquet(f"{top}/bars")
    at_once = -(-pn.partitions(s) // 3)  # in three micro-batches
    made = compile_factors([Fd("daily_mom", 5, daily=("adjusted_close",), intraday=(MID,))], dense(s, d), running.file_stream(s, f"{top}/bars", at_once), SLOTS, raw=True)
    return running.run_to_table(made, top, "factors", "append")


def _online(s: SparkSession, d: str, defs: list[Fd], **options) -> DataFrame:
    """A list online: the slots of all days arrive in three micro-batches, with a restart before each but the first."""
    top, bars_ = _streams(s), intra(s, d)
    fields = dict.fromkeys(f for x in defs for f in (*x.intraday, *x.cache) if f in bars_.columns)
    for a, b in ((0, 9), (9, 17), (17, SLOTS)):
        bars_.where((F.col("slot") >= a) & (F.col("slot") < b)).select(*SLOTKEY, *fields).write.mode("append").parquet(f"{top}/slots")
        engine = Online(defs, dense(s, d), f"{top}/online", SLOTS, days_kept=1 << 16, **options)
        engine.start(running.file_stream(s, f"{top}/slots", None)).awaitTermination()
    return engine.output()


@query("stream_group_lib", ORACLES["group_lib"])
def _stream_lib(s, d):
    return _online(s, d, groups.group("lib"))


#: Factors of the running day at three levels: first values, changes, sums, extremes and deviations are carried from batch to batch.
_TODAY = [_mom1, *[x for x in groups.group("fg260114") if x.kind.startswith("today_") or x.kind == "id" or (x.kind == "abs" and "today" in x.cache[0])]]


@query("stream_group_today", o.group_sql(_TODAY))
def _stream_today(s, d):
    return _online(s, d, _TODAY)


@query("stream_today_ranked", o.ranked_group_sql(_TODAY[:6]))
def _stream_ranked(s, d):
    """Ranks of a slot's cross-section as it closes."""
    return _online(s, d, _TODAY[:6], ranks=True)


_LEVELS = f"[{', '.join(f'CAST({p!r} AS DOUBLE)' for p in (*[i / 100 for i in range(1, 100)], *xs.TAIL_EDGES))}]"


@query(
    "stream_quantile_bins",
    "WITH e AS (SELECT CAST(ts AS DATE) AS date, value FROM events), d AS (SELECT date, list(value) AS l FROM e GROUP BY date), "
    "p AS (SELECT e.date, e.value, len(list_filter(d.l, lambda y: y <= e.value)) AS k, len(d.l) AS m FROM e JOIN d ON e.date = d.date + 1), "
    f"b AS (SELECT date, value, len(list_filter({_LEVELS}, lambda x: k >= ceil(round(x * m, 7)))) AS bin FROM p) "
    "SELECT date, 'value' AS horizon, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM b GROUP BY date, bin",
)
def _stream_bins(s, d):
    """The whole-sample quantile accumulator as a stream: each day's values binned by yesterday's sketch."""
    e = bars.events(s, d)
    sketches = ev.quantile_sketches(e, ["value"], 4096, by=["date"])
    return running.run_to_table(running.quantile_bins(running.event_stream(s, d), sketches), _streams(s), "bins", "update", ("date", "horizon", "bin"))


# Statistics kept as states by day and merged forward: the dates arrive in three parts


def _stored(s: SparkSession, name: str, stat: stats.Stat, rows: DataFrame) -> stats.Stats:
    store = stats.Stats(s, f"{_streams(s)}/stats")
    for a, b in (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-12-31")):
        store.add(name, stat, pn.between(rows, a, b))
    return store


@query("stats_volume_profile", ORACLES["vol_profile_ewma"])
def _stat_profile(s, d):
    stat = stats.STATS["volume_profile"](0.95)
    return _stored(s, "profile", stat, intra(s, d)).value("profile", stat)


@query("stats_moments", o.pick(o.DAILY, "(SELECT instrument, count(close) AS n, avg(close) AS mean, stddev_samp(close) AS std FROM daily GROUP BY instrument)", ["instrument"], ["n", "mean", "std"]))
def _stat_moments(s, d):
    stat = stats.STATS["moments"]("close")
    return _stored(s, "moments", stat, daily(s, d)).value("moments", stat)


_SPAN = "WHERE date BETWEEN DATE '2024-01-18' AND DATE '2024-01-24'"


@query("stats_window", o.pick(o.DAILY, f"(SELECT instrument, max(high) AS high, min(low) AS low FROM daily {_SPAN} GROUP BY instrument)", ["instrument"], {"high": "high", "low": "low", "range": "high - low"}))
def _stat_window(s, d):
    """A week's extremes from its days' states."""
    stat = stats.STATS["extremes"]("high", "low")
    return _stored(s, "extremes", stat, daily(s, d)).window("extremes", stat, "2024-01-18", "2024-01-24")


@query("stats_quantiles", o.pick(o.DAILY, "(SELECT 'close' AS horizon, quantile_disc(close, 0.25) AS q25, quantile_disc(close, 0.75) AS q75 FROM daily)", ["horizon"], ["q25", "q75"]))
def _stat_quantiles(s, d):
    """Quantiles of all days from their merged sketches: exact where a sketch holds every value."""
    stat = stats.STATS["quantiles"]("close", (0.25, 0.75), k=8192)
    return _stored(s, "quantiles", stat, daily(s, d)).value("quantiles", stat)


_ROLL = "OVER (PARTITION BY bucket ORDER BY date RANGE BETWEEN INTERVAL 4 DAYS PRECEDING AND CURRENT ROW)"


@query("neutralize_stored", o.pick(f"{o.DAILY}, b AS (SELECT *, instrument % 3 AS bucket FROM daily), f AS (SELECT DISTINCT bucket, date, regr_count(close, volume) {_ROLL} AS n, regr_intercept(close, volume) {_ROLL} AS i, regr_slope(close, volume) {_ROLL} AS v FROM b)", "f", ["bucket", "date", "CAST(n AS BIGINT) AS n"], {"intercept": "i", "beta_volume": "v"}, "WHERE n >= 20"))
def _rolling(s, d):
    """Fits over five days at every date, from stored sums of products."""
    stat = stats.STATS["regression"]("close", ["volume"], ("bucket",))
    store = _stored(s, "products", stat, daily(s, d).withColumn("bucket", F.col("instrument") % 3))
    return neutral.rolling_betas(store.states("products"), stat, "close", ["volume"], 5)


# The session grid ------------------------------------------------------------------------------------

_MARKS = f"[{', '.join(str(570 + m if m < 120 else 660 + m) for m in pn.sample_minutes())}]"


@query(
    "asof_session",
    "WITH t AS (SELECT user_id AS instrument, ts, last(value ORDER BY event_id) AS value FROM events GROUP BY 1, 2), "
    f"m AS (SELECT instrument, date, date + unnest({_MARKS}) * INTERVAL 1 MINUTE AS ts FROM (SELECT DISTINCT user_id AS instrument, CAST(ts AS DATE) AS date FROM events)) "
    "SELECT m.instrument, m.ts, t.ts AS tick, round(t.value, 6) + 0.0 AS value FROM m ASOF JOIN t ON m.instrument = t.instrument AND m.ts >= t.ts WHERE m.ts <= t.ts + INTERVAL 3 HOURS",
)
def _asof(s, d):
    """At each sampled minute of both sessions, the last event of the three hours before, across the break and the night."""
    e = bars.events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    marks = pn.session_marks(e.select("instrument", "date").distinct()).drop("minute", "date")
    out = pn.as_of(marks, e.select("instrument", "ts", "value", "event_id"), ["instrument"], "ts", ["value"], "3 HOURS", tie="event_id")
    return out.where("_at IS NOT NULL").select("instrument", "ts", F.col("_at").alias("tick"), "value")


# Checks while reading: gaps by column, counted in the pass that takes the rows in


@query("gap_counts", f"WITH {o.PRED} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS gaps FROM pred" for c in ("pred", "gt_1", "gt_3")))
def _gaps(s, d):
    return pn.gap_report(pred(s, d), ["pred", "gt_1", "gt_3"], lambda df: df.write.format("noop").mode("overwrite").save())


# Networks of blocks over factors

_RAW = o.group_sql(_ITEM["features"]).replace("round(CAST(", "(CAST(").replace(" AS DOUBLE), 6) + 0.0", " AS DOUBLE))")
_X, _POSITION = [x.name for x in _ITEM["features"]], "floor(slot / 24.0 * 240)"
_HEADS = mlp.init_dual_head(2, (2, 1), hidden=4, blocks=2, gated=True, seed=3, input_norm="layer")
_TWO = mlp.init_dual(2, (3, 1), compose=True, seed=5, hidden=4, blocks=1, gated=True, post_norm=True, position=4)


def _network_sql(w, dual: bool) -> str:
    n = o.NetworkSql(_RAW, SLOTKEY)
    return n.sql((n.dual if dual else n.network)(w, _X, _POSITION))


@query("infer_dual_head", _network_sql(_HEADS, False))
def _infer_heads(s, d):
    """Two towers of gated blocks after one scaled input."""
    return datasets.infer(_ITEM["features"], _HEADS, dense(s, d), intra(s, d), SLOTS, "dual_head_mlp")


@query("infer_dual", _network_sql(_TWO, True))
def _infer_dual(s, d):
    """Two networks with time embeddings and blocks that normalise their sums, composed by the day's progress."""
    return datasets.infer(_ITEM["features"], _TWO, dense(s, d), intra(s, d), SLOTS, "dual_mlp")


# The store: what is saved and read back


def _store(s: SparkSession) -> PanelStore:
    return PanelStore(s, f"{_streams(s)}/store")


_SOME = "WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND instrument IN (3, 5, 8)"


@query("store_quotation", f"WITH {o.EVENTS},\n{o.INTRA}, q AS (SELECT * REPLACE (volume + CASE WHEN date IN (DATE '2024-01-08', DATE '2024-01-09') THEN 1 ELSE 0 END AS volume) FROM intra) SELECT date, instrument, slot, round(mid_price, 6) + 0.0 AS mid_price, round(sum(volume) {o.RUN}, 6) + 0.0 AS total_volume FROM q {_SOME}")
def _store_quotation(s, d):
    """Bars saved by date, two dates replaced, and read back with filters and running volumes."""
    store, v = _store(s), Variable("quotation")
    rows = intra(s, d).select(*SLOTKEY, MID, "volume")
    store.save(v, rows)
    store.save(v, pn.between(rows, "2024-01-08", "2024-01-09").withColumn("volume", F.col("volume") + 1), overwrite=True)
    return store.quotation("2024-01-05", "2024-01-12", [3, 5, 8]).select(*SLOTKEY, MID, "total_volume")


@query("store_dates", f"WITH {o.EVENTS}, a AS (SELECT DISTINCT date FROM e) SELECT 'both' AS part, date FROM a WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' UNION ALL SELECT 'todo', date FROM a WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-20'")
def _store_dates(s, d):
    """Dates that two variables have, and those that a third still lacks."""
    store, rows = _store(s), daily(s, d).select(*KEY, F.lit(0).alias("slot"), "close")
    a, b, c = Variable("quotation"), Variable("factor", "f"), Variable("prediction", "m", 3, True)
    for v, first, last in ((a, "2024-01-01", "2024-01-20"), (b, "2024-01-10", "2024-12-31"), (c, "2024-01-01", "2024-01-12")):
        store.save(v, pn.between(rows, first, last))
    return store.dates(a, b).select(F.lit("both").alias("part"), "date").union(store.todo([a, b], c).select(F.lit("todo"), "date"))


@query("store_prediction_join", f"WITH {o.EVENTS},\n{o.INTRA} SELECT date, instrument, slot, round({L('mid_price / 100')}, 6) + 0.0 AS pred_0, CASE WHEN slot < 12 THEN round(mid_price, 6) + 0.0 END AS mid_price FROM intra WHERE instrument % 2 = 0 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _store_predictions(s, d):
    store, rows, v = _store(s), intra(s, d), Variable("prediction", "m", 7)
    store.save(Variable("quotation"), rows.where("slot < 12").select(*SLOTKEY, MID))
    store.save(v, rows.where("instrument % 2 = 0").select(*SLOTKEY, ln(F.col(MID) / 100).alias("pred_0")))
    return store.prediction_with_quotation(v, "2024-01-05", "2024-01-12").select(*SLOTKEY, "pred_0", MID)


def _slice_sql(part: str, f: str, span: str, kept: str) -> str:
    return f"SELECT '{part}' AS part, date, instrument, round(close / factor * a, 6) + 0.0 AS adjusted_close FROM (SELECT *, {f}(factor) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM daily WHERE date BETWEEN {span}) WHERE {kept}"


_BEFORE, _AFTER = "DATE '2024-01-10' AND DATE '2024-01-20'", "DATE '2024-01-14' AND DATE '2024-01-19'"


@query("store_daily_slices", f"WITH {o.DAILY} {_slice_sql('before', 'last_value', _BEFORE, "date < DATE '2024-01-20'")} UNION ALL {_slice_sql('after', 'first_value', _AFTER, 'true')}")
def _store_slices(s, d):
    """The days before a day at its prices, the days after one at its own."""
    store = _store(s)
    store.save(Variable("daily"), daily(s, d))
    tagged = lambda part, df: df.select(F.lit(part).alias("part"), *KEY, "adjusted_close")
    return tagged("before", store.daily_before("2024-01-20", 10)).union(tagged("after", store.daily_after("2024-01-14", 5)))


@query("store_daily", o.pick(o.DAILY, "daily", KEY, {"alpha": "CASE WHEN instrument % 5 = 0 THEN daily_return ELSE alpha END", "factor": "factor"}, _SOME))
def _store_daily(s, d):
    """Daily bars of a span and some instruments; a missing alpha takes the return."""
    store = _store(s)
    store.save(Variable("daily"), daily(s, d).withColumn("alpha", F.when(F.col("instrument") % 5 != 0, F.col("alpha"))))
    return store.daily("2024-01-05", "2024-01-12", [3, 5, 8], ["alpha"])


@query("store_day_loop", f"WITH {o.EVENTS},\n{o.INTRA} SELECT date, count(*) AS rows, round(sum(volume * 2), 6) + 0.0 AS total FROM intra GROUP BY date")
def _store_loop(s, d):
    """A factor made day by day from stored bars: dates arrive in two parts, each date is made once; rows are those of the manifest."""
    store, bars_, out = _store(s), intra(s, d).select(*SLOTKEY, "volume"), Variable("factor", "twice")
    build = lambda dates: store.load(Variable("quotation")).where(F.col("date").isin(dates)).withColumn("twice", F.col("volume") * 2).drop("volume")
    loop = DayLoop(store, [Variable("quotation")], out, build, at_once=8)
    for a, b in (("2024-01-01", "2024-01-11"), ("2024-01-12", "2024-12-31")):
        store.save(Variable("quotation"), pn.between(bars_, a, b))
        loop.run()
    sums = store.load(out).groupBy("date").agg(F.sum("twice").alias("total"))
    return loop.manifest().select("date", "rows").join(sums, "date")


@query("trailing_rows", o.pick(o.DAILY, "(SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date DESC) AS k FROM daily WHERE date <= DATE '2024-01-20')", KEY, ["close"], "WHERE k <= 3"))
def _trailing(s, d):
    return pn.trailing(daily(s, d), "date", "2024-01-20", 3).select(*KEY, "close")


@query("grid_position", "SELECT event_id, date_trunc('minute', ts) AS minute, slot FROM events LEFT JOIN (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS slot FROM (SELECT TIMESTAMP '2024-01-05 09:25:00' AS datetime UNION SELECT unnest(generate_series(TIMESTAMP '2024-01-05 09:30:00', TIMESTAMP '2024-01-05 11:29:00', INTERVAL 1 MINUTE)) UNION SELECT unnest(generate_series(TIMESTAMP '2024-01-05 13:00:00', TIMESTAMP '2024-01-05 14:56:00', INTERVAL 1 MINUTE)))) ON datetime = date_trunc('minute', ts) WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def _grid_position(s, d):
    """Each event's place on its day's grid of minutes, where it falls on one."""
    e = bars.events(s, d).where("date = DATE '2024-01-05'").select("event_id", F.date_trunc("minute", "ts").cast("timestamp").alias("minute"))
    return pn.on_grid(e, pn.time_grid(s, "2024-01-05").withColumn("datetime", F.col("datetime").cast("timestamp")), "minute").select("event_id", "minute", "slot")


# Series behind a report


def _ic_by_horizon(s: SparkSession, d: str) -> DataFrame:
    p = pred(s, d)
    each = [xs.ic(p, "pred", f"gt_{h}", ["date"]).select("date", F.lit(f"gt_{h}").alias("horizon"), "ic") for h in (1, 2, 3)]
    return reduce(DataFrame.union, each)


_IC = " UNION ALL ".join(f"SELECT date, 'gt_{h}' AS horizon, {h} AS step, corr(pred, gt_{h}) AS ic FROM pred WHERE pred IS NOT NULL AND gt_{h} IS NOT NULL GROUP BY date HAVING count(*) >= 20" for h in (1, 2, 3))


@query("report_decay", o.pick(f"{o.PRED}, i AS ({_IC}), j AS (SELECT horizon, step, count(*) AS n_days, avg(ic) AS mean, stddev_samp(ic) AS sd FROM i GROUP BY horizon, step)", "j", ["step", "horizon", "n_days"], {"mean": "mean", "t": "mean / (sd / sqrt(n_days))", "share": "mean / (SELECT mean FROM j WHERE step = 1)"}))
def _report_decay(s, d):
    """Saved and read again, as the evaluator's reports are."""
    folder = f"{_streams(s)}/report"
    ev.save_report({"decay": ev.decay_table(_ic_by_horizon(s, d), "ic", ["gt_1", "gt_2", "gt_3"])}, folder)
    return s.read.parquet(f"{folder}/decay")


@query("report_quantile_curve", o.pick(f"{o.PRED}, r AS (SELECT date, gt_1, row_number() OVER (PARTITION BY date ORDER BY pred, instrument) - 1 AS i, count(*) OVER (PARTITION BY date) AS n FROM pairs), b AS (SELECT date, floor(((i + 1) * 10 - 1) / n) AS bucket, count(*) AS n, avg(gt_1) AS m FROM r WHERE n >= 50 GROUP BY 1, 2), c AS (SELECT bucket, count(*) AS n_groups, sum(n) AS n, avg(m) AS m, 1.96 * stddev_samp(m) / sqrt(count(*)) AS h FROM b GROUP BY bucket)", "c", ["CAST(bucket AS BIGINT) AS bucket", "n_groups", "CAST(n AS BIGINT) AS n"], {"mean": "m", "low": "m - h", "high": "m + h"}))
def _report_quantiles(s, d):
    return ev.bucket_curve(xs.quantile_stats(pred(s, d), "pred", "gt_1", ["date"], 10))


@query("report_heat_map", o.pick(f"{o.EVENTS},\n{o.INTRA}, q AS (SELECT *, {L(MID)} - lag({L(MID)}) {o.SLOT} AS r FROM intra)", "(SELECT isodow(date) AS row, slot AS column, count(r) AS n, avg(r) AS mean FROM q WHERE r IS NOT NULL GROUP BY 1, 2)", ["CAST(row AS BIGINT) AS row", 'CAST("column" AS BIGINT) AS "column"', "n"], ["mean"]))
def _report_heat(s, d):
    """Mean returns by weekday and slot."""
    r = intra(s, d).withColumn("r", ln(MID) - F.lag(ln(MID)).over(wd.today()))
    return ev.heat_map(r, "r", (F.weekday("date") + 1), F.col("slot"))
