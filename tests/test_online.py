"""Online factors, closed slots, stored statistics, the day loop, ranks of lists, selection, pairs in blocks, as-of matches."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import panel
from tidegrid.operators import xsection as xs
from tidegrid.plans import evaluate as ev
from tidegrid.plans import neutral, stats
from tidegrid.plans.daily import DayLoop
from tidegrid.plans.factors import FactorDef as Fd
from tidegrid.plans.factors import compile_factors
from tidegrid.plans.online import Online
from tidegrid.plans.pipeline import Pipeline, store_step
from tidegrid.sources.store import PanelStore, Variable
from tidegrid.streaming import running

DAY = dt.date(2024, 1, 5)
DAYS = [DAY + dt.timedelta(days=k) for k in range(5)]
LIST = [
    Fd("daily_mom", 1, daily=("adjusted_close",), intraday=("mid_price",)),
    Fd("today_mom", cache=("daily_mom_1",)),
    Fd("today_volatility", cache=("daily_mom_1",)),
    Fd("today_skewness", cache=("daily_mom_1",)),
    Fd("today_position", intraday=("mid_price", "high", "low")),
    Fd("today_std", intraday=("volume",), prefix="volume_"),
    Fd("today_amount_ratio", intraday=("amount", "volume")),
    Fd("abs", cache=("today_mom",)),
]


@pytest.fixture(scope="module")
def market(spark):
    r = random.Random(4)
    daily = [(d, i, 100 * math.exp(r.gauss(0, 0.1)), 2.0 if d > DAYS[2] else 1.0) for d in DAYS for i in range(4)]
    bars = []
    for d in DAYS[1:]:
        for i in range(4):
            for s in range(8):
                p = None if (i == 3 and s == 5) else 100 * math.exp(r.gauss(0, 0.1))  # a gap breaks running extremes
                bars.append((d, i, s, p, None if p is None else p * 1.01, None if p is None else p * 0.99, float(r.randint(0, 5)), r.random()))
    fields = "mid_price double, high double, low double, volume double, amount double"
    return spark.createDataFrame(daily, "date date, instrument long, close double, factor double"), spark.createDataFrame(bars, f"date date, instrument long, slot int, {fields}")


def values(df):
    return {(r.date, r.instrument, r.slot): tuple(None if r[d.name] is None else round(r[d.name], 8) for d in LIST) for r in df.collect()}


@pytest.mark.parametrize("edges", [(0, 3, 8), (0, 1, 2, 5, 6, 8)])
def test_online_equals_batch_over_restarts(market, tmp_path, edges):
    daily, bars = market
    for a, b in zip(edges, edges[1:]):
        bars.where(f"slot >= {a} AND slot < {b}").write.mode("append").parquet(str(tmp_path / "in"))
        engine = Online(LIST, daily, str(tmp_path / "out"), 8, raw=True, days_kept=30)  # a new one each time
        engine.start(running.file_stream(bars.sparkSession, str(tmp_path / "in"), None)).awaitTermination()
    assert values(engine.output()) == values(compile_factors(LIST, daily, bars, 8, raw=True))
    assert len(list((tmp_path / "out" / "state").glob("[0-9]*"))) == 2  # older states go


def test_a_batch_run_again_changes_nothing(market, tmp_path):
    daily, bars = market
    from tidegrid.plans.factors import compiled

    engine = Online(LIST, daily, str(tmp_path / "out"), 8, raw=True, days_kept=30)
    c = compiled(LIST, bars.columns, 8)
    engine._history(c)
    first, second = bars.where("slot < 4"), bars.where("slot >= 4")
    for number, part in ((0, first), (1, second), (1, second)):
        engine._step(c, part, number)
    assert values(engine.output()) == values(compile_factors(LIST, daily, bars, 8, raw=True))


def test_late_rows_are_left_out(market, tmp_path):
    daily, bars = market
    from tidegrid.plans.factors import compiled

    engine = Online(LIST, daily, str(tmp_path / "out"), 8, raw=True, days_kept=1)
    c = compiled(LIST, bars.columns, 8)
    engine._history(c)
    engine._step(c, bars.where((F.col("slot") != 2) & (F.col("slot") < 5)), 0)
    late = bars.where((F.col("slot") == 2) | (F.col("slot") >= 5))
    engine._step(c, late, 1)
    got = values(engine.output())
    assert not [k for k in got if k[2] == 2]
    assert {k[0] for k in got if k[2] >= 5} == set(DAYS[-2:])  # other days are no longer kept


def test_targets_are_refused_online(market, tmp_path):
    daily, bars = market
    target = [Fd("today_targets", 2, intraday=("mid_price",) * 3)]
    bars.write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="rest of the day"):
        Online(target, daily, str(tmp_path / "out"), 8).start(running.file_stream(bars.sparkSession, str(tmp_path / "in"), None))


def test_a_slot_is_given_once_it_has_closed(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 5, h, m)
    schema = "event_id long, ts timestamp, user_id long, value double"
    seen = []
    for k, rows in enumerate(([(1, at(9, 5), 7, 1.0), (2, at(9, 50), 7, 3.0)], [(3, at(9, 40), 7, 2.0), (4, at(10, 30), 7, 5.0)], [(5, at(12, 1), 8, 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = running.file_stream(spark, str(tmp_path / "in"), None).withWatermark("ts", "30 minutes")
        got = running.run_to_table(running.closed_slots(stream), str(tmp_path / "out"), "slots", "append") if k else None
        seen.append({} if got is None else {r.slot: (r.instrument, r.volume, r.amount, r.mid_price) for r in got.collect()})
    assert seen[1] == {} or set(seen[1]) == {9}
    assert seen[2][9] == (7, 3.0, 6.0, 103.0) and seen[2][10] == (7, 1.0, 5.0, 105.0) and 12 not in seen[2]


# Ranks of lists ----------------------------------------------------------------------------


def test_all_ranks_take_one_exchange_and_equal_single_ones(spark):
    r = random.Random(2)
    rows = [(g, i, *(None if r.random() < 0.1 else r.choice([1.0, r.gauss(0, 1)]) for _ in range(5)), 3.0) for g in [*range(6), None] for i in range(200)]
    names = ["a", "b", "c", "d", "e", "same"]
    df = spark.createDataFrame(rows, "g int, i int, " + ", ".join(f"{n} double" for n in names))
    out = xs.ranked_columns(df.repartition(7), names, ["g"], 64, 2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and plan.count("Sort ") == 1
    got = {(x.g, x.i): x for x in out.collect()}
    assert len(got) == len(rows)
    for n in names:
        one = xs.binned_percentile(df, n, ["g"], 64, 2.0, name="p").select("g", "i", (4 * F.col("p") - 2).alias("r"))
        for x in one.collect():
            assert got[x.g, x.i][f"rank_{n}"] == (None if x.r is None else pytest.approx(x.r, abs=1e-9))


# Exact quantiles -------------------------------------------------------------------------------


def test_order_statistics_of_any_doubles(spark):
    r = random.Random(6)
    x = [r.choice([0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, float("inf"), float("-inf"), r.gauss(0, 1), 5.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v, None if k % 7 == 0 else float(k), None) for k, v in enumerate(x)] + [(None, float("nan"), None)], "x double, k double, none double").repartition(6)
    sizes, at = ev.order_statistics(df, ["x", "k", "none"], lambda n: [0, n // 3, n // 2, n - 1])
    ks = sorted(float(k) for k in range(3000) if k % 7)
    assert sizes == {"x": 3000, "k": len(ks), "none": 0}
    assert all(at["x", q] == sorted(x)[q] for q in (0, 1000, 1500, 2999)) and all(at["k", q] == ks[q] for q in (0, len(ks) // 3, len(ks) // 2, len(ks) - 1))


# Pairs in blocks ----------------------------------------------------------------------------------


def test_pairs_of_a_hot_group_are_spread(spark):
    r = random.Random(8)
    rows = [(0 if k < 180 else k % 9, k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(240)] + [(50, 1, 0.0, 0.0), (None, 1, 0.5, 1.0), (None, 2, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "g int, instrument int, p double, t double")
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                d = a[2] - b[2]
                n, s = want.get(a[0], (0, 0.0))
                want[a[0]] = n + 1, s + max(d, 0) + math.log1p(math.exp(-abs(d))) - d * (a[3] - b[3] > 0.001)
    got = {x.g: (x.pairs, x.loss) for x in xs.pair_loss(df, "p", "t", ["g"], block=16).collect()}
    assert set(got) == set(want) and all(got[g][0] == n and got[g][1] == pytest.approx(s / n, rel=1e-6) for g, (n, s) in want.items())
    parts = [x.pairs for x in xs.block_pairs(df, "p", "t", ["g"], block=16).where("g = 0").collect()]
    assert len(parts) > 50 and max(parts) <= 4 * 16 * 16


# As-of --------------------------------------------------------------------------------------------


def test_as_of_over_spans_and_ties(spark):
    r = random.Random(9)
    start = dt.datetime(2024, 1, 5)
    ticks = [(r.choice("ab"), start + dt.timedelta(minutes=r.randint(0, 9000)), r.randint(0, 2), r.random()) for _ in range(150)]
    marks = [(k, start + dt.timedelta(minutes=m), m) for k in "abc" for m in range(-100, 9400, 97)]
    df = panel.as_of(
        spark.createDataFrame(marks, "k string, ts timestamp, m int"), spark.createDataFrame(ticks, "k string, ts timestamp, n int, v double"), ["k"], "ts", ["v"], "20 HOURS", tie="n", width="6 HOURS"
    )
    got = {(x.k, x.m): x for x in df.collect()}
    assert len(got) == len(marks)
    for k, ts, m in marks:
        before = [t for t in ticks if t[0] == k and t[1] <= ts]
        last = max((t[1:3] for t in before), default=None)
        if last is None or ts - last[0] > dt.timedelta(hours=20):
            assert got[k, m].v is None and got[k, m]._at is None
        else:
            assert got[k, m]._at == last[0] and got[k, m].v in [t[3] for t in before if t[1:3] == last]


# Stored statistics -----------------------------------------------------------------------------------


def test_merged_states_equal_one_pass(spark, tmp_path):
    r = random.Random(3)
    rows = [(DAYS[0] + dt.timedelta(days=d), i, None if r.random() < 0.1 else r.gauss(5, 2)) for d in range(12) for i in range(3) for _ in range(r.randint(0, 6))]
    df = spark.createDataFrame(rows, "date date, instrument int, x double")
    stat, store = stats.STATS["moments"]("x"), stats.Stats(spark, str(tmp_path))
    for a, b in ((0, 3), (3, 4), (2, 9), (9, 12)):  # the third part overlaps what is there
        store.add("x", stat, df.where(F.col("date").between(DAYS[0] + dt.timedelta(days=a), DAYS[0] + dt.timedelta(days=b - 1))))
    store.add("x", stat, df)  # nothing new
    want = {x.instrument: x for x in df.groupBy("instrument").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).collect()}
    for x in store.value("x", stat).collect():
        assert (x.n, x["mean"], x["std"]) == pytest.approx((want[x.instrument].n, want[x.instrument]["mean"], want[x.instrument]["std"]))
    week = df.where(F.col("date").between(DAYS[2], DAYS[4])).groupBy("instrument").agg(F.avg("x").alias("m")).collect()
    assert {x.instrument: x["mean"] for x in store.window("x", stat, DAYS[2], DAYS[4]).collect()} == pytest.approx({x.instrument: x.m for x in week})


def test_profile_states_merge_in_any_grouping(spark):
    """(a b) c = a (b c), and both are the recurrence."""
    stat = stats.STATS["volume_profile"](0.8)
    x = [0.3, 0.9, 0.1, 0.7, 0.6]
    one = lambda v: {"n": F.lit(1.0), "first": F.lit(v), "rest": F.lit(0.0)}
    s = [one(v) for v in x]
    m = stat.merge
    ways = [m(m(m(m(s[0], s[1]), s[2]), s[3]), s[4]), m(s[0], m(s[1], m(s[2], m(s[3], s[4])))), m(m(s[0], s[1]), m(s[2], m(s[3], s[4])))]
    got = spark.range(1).select(*[stat.finish(w)["profile"].alias(f"w{k}") for k, w in enumerate(ways)]).first()
    want = x[0]
    for v in x[1:]:
        want = 0.8 * want + 0.2 * v
    assert list(got) == pytest.approx([want] * 3)


def test_rolling_betas_of_two_regressors(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(DAYS[0] + dt.timedelta(days=d), d % 1, *map(float, rng.normal(size=3))) for d in range(8) for _ in range(15)]
    df = spark.createDataFrame(rows, "date date, slot int, y double, a double, b double")
    stat, store = stats.STATS["regression"]("y", ["a", "b"]), stats.Stats(spark, str(tmp_path))
    for part in (df.where(F.col("date") <= DAYS[3]), df):
        store.add("fit", stat, part)
    got = {x.date: x for x in neutral.rolling_betas(store.states("fit"), stat, "y", ["a", "b"], 3).collect()}
    for d in range(2, 8):
        part = np.array([r[2:] for r in rows if DAYS[0] + dt.timedelta(days=d - 2) <= r[0] <= DAYS[0] + dt.timedelta(days=d)])
        want = np.linalg.lstsq(np.c_[np.ones(len(part)), part[:, 1:]], part[:, 0], rcond=None)[0]
        x = got[DAYS[0] + dt.timedelta(days=d)]
        assert [x.intercept, x.beta_a, x.beta_b] == pytest.approx(want.tolist()) and x.n == 45


# The day loop, sources, gaps ------------------------------------------------------------------------------


def test_day_loop_survives_a_kill_between_data_and_manifest(spark, tmp_path, monkeypatch):
    made = []

    def build(dates):
        made.append(list(dates))
        return store.load(quotation).where(F.col("date").isin(list(dates))).select("date", "instrument", "slot", (F.col("x") * 2).alias("f"))

    def loop(root):
        return DayLoop(PanelStore(spark, str(root)), [quotation], Variable("factor", "twice"), build, at_once=2)

    quotation = Variable("quotation")
    store = PanelStore(spark, str(tmp_path / "a"))
    store.save(quotation, spark.createDataFrame([(d, i, 0, float(i)) for d in DAYS for i in range(3)], "date date, instrument int, slot int, x double"))
    one, note = loop(tmp_path / "a"), DayLoop._note

    def killed(self, dates):
        if DAYS[2] in dates and len(made) == 2:
            raise KeyboardInterrupt
        note(self, dates)

    monkeypatch.setattr(DayLoop, "_note", killed)
    with pytest.raises(KeyboardInterrupt):
        one.run()
    assert [r.date for r in one.manifest().orderBy("date").collect()] == DAYS[:2]
    assert one.run() == 3 and made == [DAYS[:2], DAYS[2:4], DAYS[2:4], DAYS[4:]] and one.run() == 0
    got = sorted(map(tuple, store.load(Variable("factor", "twice")).select("date", "instrument", "f").collect()))
    assert got == [(d, i, 2.0 * i) for d in DAYS for i in range(3)]
    assert {(r.date, r.rows) for r in one.manifest().collect()} == {(d, 3) for d in DAYS}


@pytest.mark.parametrize("source", ["parquet", "orc"])
def test_sources_push_the_date(spark, tmp_path, source):
    store, v = PanelStore(spark, str(tmp_path), "zlib" if source == "orc" else "zstd"), Variable("factor", "f", source=source, fields=("x",))
    store.save(v, spark.createDataFrame([(d, i, 0, float(i), 1.0) for d in DAYS for i in range(3)], "date date, instrument int, slot int, x double, y double"))
    df = store.load(v, DAYS[1], DAYS[2], [1])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(instrument,1)" in plan and "y" not in plan.split("ReadSchema: ")[1].split(">")[0].replace("date", "")
    assert df.count() == 2 and store.dates(v).count() == 5
    with pytest.raises(ValueError, match="no source"):
        store.load(Variable("factor", "f", source="tape"))


def test_store_step_in_a_pipeline(spark, tmp_path):
    store, v = PanelStore(spark, str(tmp_path)), Variable("factor", "f")
    df = spark.createDataFrame([(DAYS[0], 1, 0, 2.0)], "date date, instrument int, slot int, x double")
    p = Pipeline(["bars"]).add(lambda b: b.withColumn("x", F.col("x") + 1), ["bars"], "f").add(store_step(store, v), ["f"], "stored")
    for _ in range(2):
        assert [r.x for r in p.run(bars=df)["stored"].collect()] == [3.0]


def test_gaps_are_counted_in_the_pass_that_reads(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("nan"), None, "b"), (2.0, 1.0, None)], "x double, y double, z string")
    got = panel.gap_report(df, ["x", "y", "z"], lambda d: d.write.format("noop").mode("overwrite").save()).collect()
    assert {(r.column, r.rows, r.gaps) for r in got} == {("x", 3, 1), ("y", 3, 2), ("z", 3, 1)}
