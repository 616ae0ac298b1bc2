"""Independent SQL for the registered queries, for an engine that knows standard SQL and Parquet views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


EVENTS = """e AS (SELECT event_id, ts, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS slot, user_id AS instrument, event_type, value, value + 100 AS px FROM events)"""

DAILY = f"""{EVENTS},
d0 AS (SELECT date, instrument, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, event_id) AS close,
  CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount,
  CASE WHEN instrument % 3 = 0 AND date >= DATE '2024-01-16' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM e GROUP BY date, instrument),
d1 AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY date)), 0) AS daily_return FROM d0),
daily AS (SELECT *, CASE WHEN instrument % 7 = 0 THEN daily_return ELSE daily_return - avg(daily_return) OVER (PARTITION BY date) END AS alpha FROM d1)"""

_LEVELS = ("open", "high", "low", "close", "factor", "alpha")


def _dense(source: str, levels: Sequence[str]) -> str:
    filled = ", ".join(f"last_value(p.{c} IGNORE NULLS) OVER w AS {c}" for c in levels)
    zero = ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in ("volume", "amount", "daily_return"))
    return f"""cal AS (SELECT DISTINCT date FROM {source}), inst AS (SELECT DISTINCT instrument FROM {source}),
dense AS (SELECT c.date, i.instrument, {filled}, {zero} FROM cal c CROSS JOIN inst i LEFT JOIN {source} p ON p.date = c.date AND p.instrument = i.instrument
  WINDOW w AS (PARTITION BY i.instrument ORDER BY c.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


DENSE = DAILY + ",\n" + _dense("daily", _LEVELS)

_PRICES = ("mid_price", "high", "low", "bid_price1", "ask_price1")
_FLOWS = ("volume", "amount", "buy_amount", "sell_amount", "bid_volume1", "ask_volume1")
HOURLY = """h0 AS (SELECT date, slot, instrument, last(px ORDER BY ts, event_id) AS mid_price, max(px) AS high, min(px) AS low, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount,
  sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS buy_amount, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS sell_amount,
  sum(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0 END) AS bid_volume1, sum(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS ask_volume1 FROM e GROUP BY date, slot, instrument),
h1 AS (SELECT *, CASE WHEN bid_volume1 > 0 THEN mid_price * 0.9995 ELSE 0 END AS bid_price1, CASE WHEN ask_volume1 > 0 THEN mid_price * 1.0005 ELSE 0 END AS ask_price1 FROM h0)"""
INTRA = f"""{HOURLY},
g AS (SELECT date, instrument, unnest(range(24)) AS slot FROM (SELECT DISTINCT date, instrument FROM h1)),
f0 AS (SELECT g.date, g.instrument, g.slot, {", ".join(f"last_value(h.{c} IGNORE NULLS) OVER w AS {c}" for c in _PRICES)}, {", ".join(f"coalesce(h.{c}, 0) AS {c}" for c in _FLOWS)}
  FROM g LEFT JOIN h1 h ON h.date = g.date AND h.instrument = g.instrument AND h.slot = g.slot
  WINDOW w AS (PARTITION BY g.instrument, g.date ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f1 AS (SELECT date, instrument, slot, {", ".join(f"first_value({c} IGNORE NULLS) OVER w AS {c}" for c in _PRICES)}, {", ".join(_FLOWS)} FROM f0
  WINDOW w AS (PARTITION BY instrument, date ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
intra AS (SELECT *, volume AS total_volume, {ln('mid_price / 100')} AS resid, mid_price / (mid_price + 100) AS resid_rank FROM f1)"""

MONTH = """month AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY date)), 0) AS daily_return FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS instrument, avg(l_extendedprice / l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, avg(l_discount) - avg(l_tax) AS alpha FROM lineitem GROUP BY 1, 2))"""
MONTH_DENSE = MONTH + ",\n" + _dense("month", ("close", "high", "low", "alpha"))

#: Half months as days and four slots each: long enough for windows of 126 days.
_HALVES = """l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) + CASE WHEN day(l_shipdate) > 15 THEN 15 ELSE 0 END AS date, l_suppkey AS instrument, CAST(((day(l_shipdate) - 1) % 15) // 4 AS INTEGER) AS slot,
  l_extendedprice / l_quantity AS px, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS a, l_returnflag, l_linestatus, l_discount - l_tax AS net FROM lineitem)"""
LONG_DENSE = f"""{_HALVES},
l0 AS (SELECT date, instrument, avg(px) AS close, max(px) AS high, min(px) AS low, sum(q) AS volume, sum(a) AS amount, avg(net) AS alpha,
  CASE WHEN instrument % 3 = 0 AND date >= DATE '1995-01-01' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM l GROUP BY date, instrument),
ldaily AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY date)), 0) AS daily_return FROM l0),
{_dense("ldaily", ("high", "low", "close", "factor", "alpha"))}"""
LONG_INTRA = f"""h0 AS (SELECT date, slot, instrument, avg(px) AS mid_price, max(px) AS high, min(px) AS low, sum(q) AS volume, sum(a) AS amount,
  sum(CASE WHEN l_returnflag = 'R' THEN a ELSE 0 END) AS buy_amount, sum(CASE WHEN l_returnflag = 'A' THEN a ELSE 0 END) AS sell_amount,
  sum(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS bid_volume1, sum(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS ask_volume1 FROM l GROUP BY date, slot, instrument),
{INTRA[INTRA.index('h1 AS'):].replace('range(24)', 'range(4)')}"""

PRED = f"""{DENSE},
pred AS (SELECT date, instrument, ({ln('close')} - {ln('lag(close, 5) OVER w')}) / sqrt(5) AS pred,
  {", ".join(f"{ln(f'lead(close, {h}) OVER w')} - {ln('close')} AS gt_{h}" for h in (1, 2, 3))}
  FROM dense WINDOW w AS (PARTITION BY instrument ORDER BY date)),
pairs AS (SELECT * FROM pred WHERE pred IS NOT NULL AND gt_1 IS NOT NULL)"""


def pick(ctes: str, source: str, keys: Sequence[str], floats: Sequence[str] | Mapping[str, str], where: str = "", digits: int = 6) -> str:
    """The final selection: keys as they are, floats rounded to so many decimals."""
    named = floats if isinstance(floats, Mapping) else {f: f for f in floats}
    values = [f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {n}" for n, x in named.items()]
    return f"WITH {ctes}\nSELECT {', '.join([*keys, *values])} FROM {source} {where}"


def back(w: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


BY_DAY = "OVER (PARTITION BY instrument ORDER BY date)"
RUN = "OVER (PARTITION BY instrument, date ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SLOT = "OVER (PARTITION BY instrument, date ORDER BY slot)"
REST = "OVER (PARTITION BY instrument, date ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def factor_sql(day: Mapping[str, str], final: Mapping[str, str], running: Sequence[Mapping[str, str]] = (), day2: Mapping[str, str] | None = None) -> str:
    """History columns on the dense grid, joined to the hours, running columns in stages, then the factors."""
    feats = ", ".join(f"{x} AS {n}" for n, x in day.items()) or "1 AS one"
    sql = f"{DENSE},\n{INTRA},\ndayf AS (SELECT *, close / factor AS ac, {feats} FROM dense)"
    source = "dayf"
    if day2:
        sql += f",\ndayg AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in day2.items())} FROM dayf)"
        source = "dayg"
    names = [*day, *(day2 or {})]
    sql += f",\nr0 AS (SELECT i.*, d.factor{''.join(f', d.{n}' for n in names)} FROM intra i JOIN {source} d ON d.date = i.date AND d.instrument = i.instrument)"
    last = "r0"
    for k, stage in enumerate(running, 1):
        sql += f",\nr{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})"
        last = f"r{k}"
    return pick(sql, last, ["date", "instrument", "slot"], final)


AC = "(close / factor)"
MOM1 = f"{ln('mid_price')} - {ln('y')}"
YEST = f"lag({AC}) {BY_DAY} * factor"


def power(x: str, k: int, w: int) -> str:
    return f"coalesce(sum({' * '.join([x] * k)}) {back(w)}, 0)" if k else f"CAST(count({x}) {back(w)} AS DOUBLE)"


def skew_pop(n: str, s1: str, s2: str, s3: str) -> str:
    m2 = f"(({s2}) / ({n}) - (({s1}) / ({n})) * (({s1}) / ({n})))"
    m3 = f"(({s3}) / ({n}) - 3 * (({s1}) / ({n})) * ({s2}) / ({n}) + 2 * pow(({s1}) / ({n}), 3))"
    return f"CASE WHEN ({n}) IS NULL OR {m2} IS NULL OR ({n}) < 3 THEN NULL WHEN {m2} < 1e-12 THEN 0 ELSE {m3} / pow({m2}, 1.5) END"


def skew_adj(n: str, s1: str, s2: str, s3: str) -> str:
    m2 = f"({s2} - {s1} * {s1} / {n})"
    m3 = f"({s3} - 3 * ({s1} / {n}) * {s2} + 2 * {n} * pow({s1} / {n}, 3))"
    return f"CASE WHEN {n} < 3 THEN 0 WHEN {m2} <= greatest(1e-18, {s2} * 1e-13) THEN 0 ELSE {n} * sqrt({n} - 1) / ({n} - 2) * {m3} / pow({m2}, 1.5) END"


def kurt(n: str, s1: str, s2: str, s3: str, s4: str) -> str:
    mu, ssd = f"(({s1}) / ({n}))", f"(({s2}) - ({s1}) * ({s1}) / ({n}))"
    m4 = f"(({s4}) - 4 * {mu} * ({s3}) + 6 * {mu} * {mu} * ({s2}) - 3 * ({n}) * pow({mu}, 4))"
    return f"CASE WHEN {ssd} IS NULL THEN NULL WHEN {ssd} <= 1e-12 THEN 0 ELSE ({n} * ({n} + 1) / (({n} - 1) * ({n} - 2) * ({n} - 3))) * {m4} * ({n} - 1) * ({n} - 1) / ({ssd} * {ssd}) - 3 * ({n} - 1) * ({n} - 1) / (({n} - 2) * ({n} - 3)) END"


def binned(ctes: str, source: str, x: str, by: str, bins: int, sigmas: float, sample: bool, keys: Sequence[str], name: str = "rank", scaled: str = "{}") -> str:
    sd = "stddev_samp" if sample else "stddev_pop"
    bin_ = f"least(greatest(floor((v - lo) * {bins} / (hi - lo)), 0), {bins - 1})"
    if sample:
        bin_ = f"CASE WHEN v <= lo THEN -1 WHEN v >= hi THEN {bins} ELSE {bin_} END"
    return pick(
        f"""{ctes},
b0 AS (SELECT *, {x} AS v, count({x}) OVER (PARTITION BY {by}) AS m, {sd}({x}) OVER (PARTITION BY {by}) AS sd, avg({x}) OVER (PARTITION BY {by}) AS mu FROM {source}),
b1 AS (SELECT *, mu - sd * {sigmas} AS lo, mu + sd * {sigmas} AS hi, coalesce(sd < 1e-12, true) AS flat FROM b0),
b2 AS (SELECT *, CASE WHEN NOT flat AND v IS NOT NULL THEN {bin_} END AS k, CASE WHEN NOT flat THEN (v - lo) * {bins} / (hi - lo) END AS place FROM b1),
b3 AS (SELECT *, count(v) OVER (PARTITION BY {by}, k) AS here, count(v) OVER (PARTITION BY {by} ORDER BY k NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM b2)""",
        "b3", keys, {name: scaled.format("CASE WHEN v IS NULL THEN NULL WHEN flat THEN 0.5 WHEN v <= lo THEN 0 WHEN v >= hi THEN 1 ELSE (upto - here + here * (place - k)) / m END")},
    )


class GroupSql:
    """The SQL of a list of factors, from the formulas written out above: one query with all their columns."""

    def __init__(self, defs, slots: int = 24) -> None:
        self.day: dict[str, str] = {}
        self.day2: dict[str, str] = {}
        self.running: list[dict[str, str]] = [{}, {}, {}]
        self.values: dict[str, str] = {}
        self.ranked: dict[str, str] = {}
        self.slots = slots
        for d in defs:
            self._add(d)

    def _put(self, store: dict[str, str], name: str, value: str) -> str:
        store.setdefault(name, value)
        return name

    def _field(self, f: str) -> tuple[str, str]:
        """The field on the factor-free scale, and what brings it back to a day."""
        if not f.startswith("adjusted_"):
            return f, "* 1"
        raw = f.removeprefix("adjusted_")
        return (f"({raw} * factor)", "/ factor") if raw in ("volume", "amount") else (f"({raw} / factor)", "* factor")

    def _sum(self, f: str, k: int, w: int) -> str:
        return self._put(self.day, f"s{k}_{f}_{w}", power(f, k, w)) if w else "0"

    def _mean(self, f: str, w: int) -> str:
        x, back_to = self._field(f)
        return self._put(self.day, f"m_{f}_{w}", f"avg({x}) {back(w)} {back_to}")

    def _now(self, d) -> str:
        f = (d.cache or d.intraday)[0]
        return f"({self.values[f]})" if f in self.values else f

    def _column(self, d) -> str:
        """Today's value as a column of a running stage."""
        f = (d.cache or d.intraday)[0]
        return self._put(self.running[0], f"v_{f}", self._now(d))

    def _moments(self, d) -> dict[str, str]:
        n, w = f"({self._sum(d.daily[0], 0, d.window - 1)} + 1)", d.window - 1
        r = self._now(d)
        return {"n": n} | {f"s{k}": f"({self._sum(d.daily[0], k, w)} + {' * '.join([r] * k)})" for k in (1, 2, 3, 4)}

    def _change_moments(self, v: str) -> tuple[str, ...]:
        change = self._put(self.running[1], f"d_{v}", f"CASE WHEN slot = 0 THEN {v} ELSE {v} - lag({v}) {SLOT} END")
        return change, *self._sums(change)

    def _sums(self, x: str) -> tuple[str, ...]:
        n = self._put(self.running[2], f"n_{x}", f"CAST(count({x}) {RUN} AS DOUBLE)")
        return n, *[self._put(self.running[2], f"r{k}_{x}", f"coalesce(sum({' * '.join([x] * k)}) {RUN}, 0)") for k in (1, 2, 3)]

    def _total(self, f: str) -> str:
        return self._put(self.running[0], f"t_{f}", f"sum({f}) {RUN}")

    def _add(self, d) -> None:
        w, root_w = d.window, f"sqrt({max(d.window, 1)})"
        share = f"((slot + 1) / {self.slots}.0)"
        if d.kind == "price_dev_from_ma":
            out = f"({ln(d.intraday[0])} - {ln(self._mean(d.daily[0], w))}) / {root_w}"
        elif d.kind == "price_dev_from_vwap":
            b = back(w)
            m = self._put(self.day, f"vwap_{w}", f"CASE WHEN coalesce(sum(volume) {b}, 0) = 0 THEN avg({AC}) {b} * factor ELSE coalesce(sum({AC} * volume) {b}, 0) * factor / (coalesce(sum(volume) {b}, 0) + 1e-6) END")
            out = f"({ln(d.intraday[0])} - {ln(m)}) / {root_w}"
        elif d.kind == "price_position":
            p = d.intraday[0]
            hi = self._put(self.day, f"hi_{w}", f"max(high / factor) {back(w)} * factor")
            lo = self._put(self.day, f"lo_{w}", f"min(low / factor) {back(w)} * factor")
            out = f"CASE WHEN {hi} IS NOT NULL AND greatest({hi}, {p}) > least({lo}, {p}) THEN ({p} - least({lo}, {p})) / (greatest({hi}, {p}) - least({lo}, {p})) END"
        elif d.kind == "daily_mom":
            out = f"({ln(d.intraday[0])} - {ln(self._put(self.day, f'lag_{w}', f'lag({AC}, {w}) {BY_DAY} * factor'))}) / {root_w}"
        elif d.kind == "daily_mom_sum":
            out = f"({d.intraday[0]} + {self._sum(d.daily[0], 1, w - 1)}) / {root_w}"
        elif d.kind == "daily_volatility":
            m = self._moments(d)
            out = f"sqrt({m['s2']} / {m['n']})"
        elif d.kind == "daily_skewness":
            m = self._moments(d)
            out = skew_pop(m["n"], m["s1"], m["s2"], m["s3"])
        elif d.kind == "daily_kurtosis":
            m = self._moments(d)
            out = f"CASE WHEN {m['n']} >= {w} THEN {kurt(f'{w}.0', m['s1'], m['s2'], m['s3'], m['s4'])} END"
        elif d.kind == "daily_volvol":
            f, w2, r = d.daily[0], d.window2, self._now(d)
            over = f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            v = self._put(self.day, f"vol_{f}_{w}", f"CASE WHEN count(*) {over} >= {w} THEN sqrt(coalesce(sum({f} * {f}) {over}, 0) / {w}) END")
            a, b = (self._put(self.day2, f"{n}_{f}_{w}_{w2}", f"CASE WHEN count({v}) {back(w2 - 1)} >= {w2 - 1} THEN sum({x}) {back(w2 - 1)} END") for n, x in (("vv1", v), ("vv2", f"{v} * {v}")))
            q = f"({self._sum(f, 2, w - 1)} + {r} * {r}) / {w}"
            out = f"CASE WHEN {a} IS NOT NULL AND {r} IS NOT NULL THEN sqrt(greatest(({b} + {q}) / {w2} - pow(({a} + sqrt({q})) / {w2}, 2), 0)) END"
        elif d.kind == "daily_recent_vacancy":
            out = f"CASE WHEN {self._put(self.day, f'c_{w}', f'CAST(count({AC}) {back(w)} AS DOUBLE)')} / {w} > {d.threshold} THEN 1 ELSE 0 END"
        elif d.kind == "volume_ratio":
            out = f"{ln(f'({self._total(d.intraday[0])} + 1) / {share}')} - {ln(self._mean(d.daily[0], w))}"
        elif d.kind == "rv_corr":
            f, r, v = d.daily[0], self._now(d), f"({self._total(d.intraday[-1])} / {share})"
            y, b = "(volume * factor)", back(w - 1)
            put = lambda n, x, to="": self._put(self.day, f"{n}_{f}_{w}", f"coalesce(sum(CASE WHEN {f} IS NOT NULL AND {y} IS NOT NULL THEN {x} END) {b}, 0) {to}")
            n = f"({self._put(self.day, f'pn_{f}_{w}', f'CAST(count({f} * {y}) {b} AS DOUBLE)')} + 1)"
            sx, sxx = f"({put('px', f)} + {r})", f"({put('pxx', f'{f} * {f}')} + {r} * {r})"
            sy, syy = f"({put('py', y, '/ factor')} + {v})", f"({put('pyy', f'{y} * {y}', '/ (factor * factor)')} + {v} * {v})"
            sxy = f"({put('pxy', f'{f} * {y}', '/ factor')} + {r} * {v})"
            out = f"CASE WHEN {n} >= {max(2, w // 2)} AND {n} * {sxx} - pow({sx}, 2) > 1e-12 AND {n} * {syy} - pow({sy}, 2) > 1e-12 THEN ({n} * {sxy} - {sx} * {sy}) / sqrt(({n} * {sxx} - pow({sx}, 2)) * ({n} * {syy} - pow({sy}, 2))) END"
        elif d.kind in ("today_mom", "today_volatility", "today_skewness"):
            v = self._column(d)
            if d.kind == "today_mom":
                out = f"{v} - {self._put(self.running[1], f'o_{v}', f'first_value({v}) {RUN}')}"
            else:
                change, n, s1, s2, s3 = self._change_moments(v)
                out = f"CASE WHEN {n} > 1 THEN sqrt({s2} / ({n} - 1)) ELSE sqrt({s2}) * 0.5 END" if d.kind == "today_volatility" else f"CASE WHEN {change} IS NOT NULL THEN {skew_adj(n, s1, s2, s3)} END"
        elif d.kind == "today_position":
            p, h, lo_f = d.intraday
            gap = lambda f: f"count({f}) {RUN} = count(*) {RUN}"
            hi = self._put(self.running[0], f"rh_{h}", f"CASE WHEN {gap(h)} THEN max({h}) {RUN} END")
            lo = self._put(self.running[0], f"rl_{lo_f}", f"CASE WHEN {gap(lo_f)} THEN min({lo_f}) {RUN} END")
            out = f"CASE WHEN {p} = 0 OR coalesce({hi} - {lo}, 0) = 0 THEN 0.5 ELSE ({p} - {lo}) / ({hi} - {lo}) END"
        elif d.kind in ("today_std", "today_log_skewness"):
            x = self._put(self.running[0], f"lv_{d.intraday[0]}", f"ln({d.intraday[0]} + 1)")
            out = self._put(self.running[1], f"sd_{x}", f"stddev_pop({x}) {RUN}") if d.kind == "today_std" else skew_adj(*self._sums(x))
        elif d.kind == "today_amount_ratio":
            out = f"{self._total(d.intraday[0])} / ({self._total(d.intraday[1])} + 1)"
        elif d.kind in ("id", "abs"):
            out = self._now(d) if d.kind == "id" else f"abs({self._now(d)})"
        elif d.kind == "is_tradable":
            p, ask, bid = d.intraday
            y = self._put(self.day, "yest", YEST)
            at = " OR ".join(f"round_even(({p} / {y} - 1) * 100, 0) / 100 = {x}" for x in (0.05, 0.1, 0.2))
            out = f"1 - CASE WHEN {y} IS NOT NULL AND ({at}) AND {ask} = 0 AND {bid} > 0 THEN 1 ELSE 0 END"
        elif d.kind == "future_day_targets":
            out = f"{ln(self._put(self.day, f'f_{w}', f'lead({AC}, {w}) {BY_DAY} * factor'))} - {ln(self._price(d.intraday[0], d.intraday[-1]))}"
        elif d.kind == "today_targets":
            buy, sell, mid = d.intraday
            price = self._put(self.running[0], f"sell_{sell}", self._price(sell, mid))
            then = self._put(self.running[1], f"to_{sell}_{w}", f"coalesce(lead({price}, {w}) {SLOT}, last_value({price}) {REST})")
            out = f"{ln(then)} - {ln(self._price(buy, mid))}"
        elif d.kind.startswith("future_day_") and d.kind.endswith("range_targets"):
            ahead = f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)"
            hi, lo = (self._put(self.day, f"f{a}_{w}", f"{a}({c} / factor) {ahead} * factor") for a, c in (("max", "high"), ("min", "low")))
            one, two = {"future_day_range_targets": (hi, lo), "future_day_up_range_targets": (hi, MID_FIELD), "future_day_down_range_targets": (lo, MID_FIELD)}[d.kind]
            out = f"{ln(one)} - {ln(two)}"
        elif d.kind == "rank_targets":
            self.ranked[d.name] = d.cache[0]
            self.values[d.name] = "NULL"
            return
        else:
            raise ValueError(f"no SQL for {d.kind}")
        self.values[d.name] = out

    @staticmethod
    def _price(price: str, mid: str) -> str:
        return price if price == mid else f"(CASE WHEN {price} = 0 THEN {mid} ELSE {price} END)"


MID_FIELD = "mid_price"


def _group_ctes(defs, base: str = f"{DENSE},\n{INTRA}", slots: int = 24) -> tuple[str, str]:
    """Common table expressions of a list's raw factors over the panels `dense` and `intra`, and the name of the last."""
    g = GroupSql(defs, slots)
    day = ", ".join(f"{x} AS {n}" for n, x in g.day.items()) or "1 AS one"
    day2 = "".join(f", {x} AS {n}" for n, x in g.day2.items())
    names = [*g.day, *g.day2]
    sql = f"{base},\ndayf AS (SELECT *, close / factor AS ac, {day} FROM dense),\ndayg AS (SELECT *{day2} FROM dayf),\nr0 AS (SELECT i.*, d.factor{''.join(f', d.{n}' for n in names)} FROM intra i JOIN dayg d ON d.date = i.date AND d.instrument = i.instrument)"
    last = "r0"
    for k, stage in enumerate(g.running, 1):
        if stage:
            sql += f",\nr{k} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in stage.items())} FROM {last})"
            last = f"r{k}"
    plain = {d.name: f"({g.values[d.name]})" for d in defs if d.name not in g.ranked}
    sql += f",\nraw AS (SELECT date, instrument, slot, {', '.join(f'{x} AS {n}' for n, x in plain.items())} FROM {last})"
    last = "raw"
    for k, (name, of) in enumerate(g.ranked.items()):
        by, bins, sigmas = "PARTITION BY date, slot", 2000, 3.5
        sql += f""",
q{k}a AS (SELECT *, count({of}) OVER ({by}) AS qm, stddev_samp({of}) OVER ({by}) AS qs, avg({of}) OVER ({by}) AS qa FROM {last}),
q{k}b AS (SELECT *, qa - qs * {sigmas} AS lo, qa + qs * {sigmas} AS hi, coalesce(qs < 1e-12, true) AS flat FROM q{k}a),
q{k}c AS (SELECT *, CASE WHEN NOT flat AND {of} IS NOT NULL THEN CASE WHEN {of} <= lo THEN -1 WHEN {of} >= hi THEN {bins} ELSE least(greatest(floor(({of} - lo) * {bins} / (hi - lo)), 0), {bins - 1}) END END AS k, CASE WHEN NOT flat THEN ({of} - lo) * {bins} / (hi - lo) END AS place FROM q{k}b),
q{k}d AS (SELECT *, count({of}) OVER (PARTITION BY date, slot, k) AS here, count({of}) OVER ({by} ORDER BY k NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q{k}c),
q{k} AS (SELECT * EXCLUDE (qm, qs, qa, lo, hi, flat, k, place, here, upto), CASE WHEN {of} IS NULL THEN NULL WHEN flat THEN 0.5 WHEN {of} <= lo THEN 0 WHEN {of} >= hi THEN 1 ELSE (upto - here + here * (place - k)) / qm END AS {name} FROM q{k}d)"""
        last = f"q{k}"
    return sql, last


def _clipped(d) -> str:
    return f"CASE WHEN {d.name} IS NOT NULL THEN greatest(least(({d.name} - {d.shift}) * {d.scale}, {d.upper}), {d.lower}) END"


def group_sql(defs) -> str:
    """date, instrument, slot and every factor of the list, shifted, scaled and clipped; ranked targets by the binned percentile of the slot."""
    sql, last = _group_ctes(defs)
    return pick(sql, last, ["date", "instrument", "slot"], {d.name: _clipped(d) for d in defs})


def long_group_sql(defs, digits: int = 4) -> str:
    """group_sql over the half months."""
    sql, last = _group_ctes(defs, f"{LONG_DENSE},\n{LONG_INTRA}", 4)
    return pick(sql, last, ["date", "instrument", "slot"], {d.name: _clipped(d) for d in defs}, digits=digits)


def ranked_group_sql(defs, bins: int = 2000, sigmas: float = 3.5) -> str:
    """group_sql with rank_x, the scaled binned percentile of each raw factor in its slot: the factors are unpivoted, ranked and pivoted again."""
    sql, last = _group_ctes(defs)
    names = [d.name for d in defs]
    by = "PARTITION BY date, slot, name"
    sql += f""",
u AS (SELECT date, instrument, slot, unnest([{", ".join(f"'{n}'" for n in names)}]) AS name, unnest([{", ".join(f"CAST({n} AS DOUBLE)" for n in names)}]) AS v FROM {last}),
u1 AS (SELECT *, count(v) OVER ({by}) AS m, avg(v) OVER ({by}) AS mu, stddev_pop(v) OVER ({by}) AS sd FROM u),
u2 AS (SELECT *, mu - sd * {sigmas} AS lo, mu + sd * {sigmas} AS hi, coalesce(sd < 1e-12, true) AS flat FROM u1),
u3 AS (SELECT *, CASE WHEN NOT flat AND v IS NOT NULL THEN least(greatest(floor(round(place, 6)), 0), {bins - 1}) END AS k FROM (SELECT *, CASE WHEN NOT flat THEN (v - lo) * {bins} / (hi - lo) END AS place FROM u2)),
u4 AS (SELECT *, count(v) OVER (PARTITION BY date, slot, name, k) AS here, count(v) OVER ({by} ORDER BY k NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM u3),
u5 AS (SELECT date, instrument, slot, name, 4 * CASE WHEN v IS NULL THEN NULL WHEN flat THEN 0.5 WHEN v <= lo THEN 0 WHEN v >= hi THEN 1 ELSE (upto - here + here * (place - k)) / m END - 2 AS r FROM u4),
u6 AS (SELECT date, instrument, slot, {", ".join(f"max(r) FILTER (WHERE name = '{n}') AS rank_{n}" for n in names)} FROM u5 GROUP BY date, instrument, slot),
z AS (SELECT * FROM {last} JOIN u6 USING (date, instrument, slot))"""
    return pick(sql, "z", ["date", "instrument", "slot"], {d.name: _clipped(d) for d in defs} | {f"rank_{n}": f"rank_{n}" for n in names})


class NetworkSql:
    """The forward pass of a residual network written out, a column for each unit; SwiGLU blocks only, as SQL has no error function."""

    def __init__(self, source: str, keys: Sequence[str]) -> None:
        self.steps, self.last, self.keys, self.made = [f"n0 AS (SELECT * FROM ({source}))"], "n0", keys, 0

    def put(self, values: Sequence[str]) -> list[str]:
        """New columns beside all there are."""
        names = [f"u{self.made + i}" for i in range(len(values))]
        self.made += len(values)
        self.steps.append(f"m{self.made} AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in zip(names, values, strict=True))} FROM {self.last})")
        self.last = f"m{self.made}"
        return names

    def linear(self, x: Sequence[str], layer) -> list[str]:
        return self.put([" + ".join([f"{float(layer[0][i, j])!r} * {n}" for i, n in enumerate(x)] + [repr(float(layer[1][j]))]) for j in range(len(layer[1]))])

    def norm(self, x: Sequence[str]) -> list[str]:
        (mean,) = self.put([f"({' + '.join(x)}) / {len(x)}.0"])
        (sd,) = self.put([f"sqrt(({' + '.join(f'({v} - {mean}) * ({v} - {mean})' for v in x)}) / {len(x)}.0 + 1e-5)"])
        return self.put([f"({v} - {mean}) / {sd}" for v in x])

    def tower(self, blocks, h: list[str]) -> list[str]:
        for b in blocks:
            z = h if b["post_norm"] else self.norm(h)
            gate, up = self.linear(z, b["gate"]), self.linear(z, b["up"])
            z = self.put([f"{g} / (1 + exp(-{g})) * {u}" for g, u in zip(gate, up, strict=True)])
            h = self.put([f"{a} + {d}" for a, d in zip(h, self.linear(z, b["down"]), strict=True)])
            h = self.norm(h) if b["post_norm"] else h
        return h

    def network(self, w, x: Sequence[str], position: str) -> list[str]:
        h = self.linear(self.norm(x) if w["input_norm"] is not None else x, w["in"])
        if "towers" in w:
            return [y for t in w["towers"] for y in self.linear(self.tower(t["blocks"], h), t["out"])]
        if w["position"] is not None:
            d = len(w["position"][0])
            waves = self.put([f"{f}({position} * exp(-{i} * ln(500.0) / {d}))" for i in range(0, d, 2) for f in ("sin", "cos")])
            h = self.put([f"{a} + {b}" for a, b in zip(h, self.linear(waves, w["position"]), strict=True)])
        return self.linear(self.tower(w["blocks"], h), w["out"])

    def dual(self, w, x: Sequence[str], position: str) -> list[str]:
        one, two = (self.network(w[k], x, position) for k in ("first", "second"))
        return [*one, *two, *self.put([f"{y} + {two[0]} * {position} / 240 * {share}" for y, share in zip(one, ("1 / 9.0", "1 / 6.0", "1 / 3.0"), strict=True)])]

    def sql(self, outputs: Sequence[str]) -> str:
        return pick(", ".join(self.steps), self.last, self.keys, {f"pred_{i}": n for i, n in enumerate(outputs)})
