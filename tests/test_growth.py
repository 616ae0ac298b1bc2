"""What queries need to stay in proportion to their input."""

import pytest
from pyspark.sql import functions as F

from tidegrid import functions as fn
from tidegrid.sources import bars


def test_rounding_is_in_doubles_with_halves_away_from_zero(spark):
    x = [0.0003125, -0.0003125, 1.2345675, 2.5e-7, -7.4999999e-7, 1e300, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    out = fn.rounded(df)
    assert "round(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["x"] for r in out.collect()}
    assert [got[i] for i in (0, 1, 3, 4, 5, 6, 7)] == [0.000313, -0.000313, 0.0, -1e-6, 1e300, float("inf"), None]
    assert got[2] == pytest.approx(1.234568, abs=1e-12)


def test_gaps_of_a_day_are_filled_over_the_bars_there_are(spark):
    rows = [(1, 2, 10.0, 5.0), (1, 4, None, 1.0), (1, 5, 12.0, None), (2, 0, None, 3.0)]
    b = spark.createDataFrame(rows, "instrument long, slot int, mid_price double, volume double").withColumn("date", F.lit("2024-01-02").cast("date"))
    out = bars._gridded(b, 7)
    got = {(r["instrument"], r["slot"]): (r["mid_price"], r["volume"]) for r in out.collect()}
    assert len(got) == 14
    assert [got[1, s] for s in range(7)] == [(10.0, 0.0), (10.0, 0.0), (10.0, 5.0), (10.0, 0.0), (12.0, 1.0), (12.0, None), (12.0, 0.0)]
    assert [got[2, s] for s in range(7)] == [(None, 3.0)] + [(None, 0.0)] * 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")]  # none over the grid


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    from tidegrid import catalogue

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    catalogue.QUERIES["panel_daily_ohlcv"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


@pytest.mark.parametrize("crossing", [False, True])
def test_pair_sums_equal_all_pairs(crossing):
    import time

    import numpy as np

    from tidegrid.operators import xsection as xs

    draw = np.random.default_rng(3)
    n = 700
    i, p, g = draw.integers(0, 500, n), draw.normal(0, 3, n), np.round(draw.normal(0, 0.002, n), 3)
    own = draw.random(n) < 0.4
    d = p[:, None] - p[None, :]
    loss = np.maximum(d, 0) + np.log1p(np.exp(-np.abs(d))) - d * (g[:, None] - g[None, :] > 0.001)
    met = i[:, None] < i[None, :]
    if crossing:
        met &= own[:, None] != own[None, :]
    pairs, total = xs._pair_sum(i, p, g, own, crossing, 0.001)
    assert pairs == met.sum() and total == pytest.approx(loss[met].sum(), rel=1e-10)
    n = 60_000  # 1.8 thousand million pairs
    began = time.time()
    pairs, _ = xs._pair_sum(np.arange(n), draw.normal(0, 0.1, n), draw.normal(0, 0.02, n), np.zeros(n, bool), False, 0.001)
    assert pairs == n * (n - 1) // 2 and time.time() - began < 20


@pytest.mark.parametrize("margin", [0.02, 0.0])
def test_streamed_quantiles_of_a_long_day_are_exact(spark, tmp_path, margin):
    from tidegrid.plans import evaluate as ev
    from tidegrid.streaming import running

    rows = spark.range(60_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 80_000).cast("timestamp_ntz").alias("ts"), F.round(F.rand(5) * 1e4, 1).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = lambda: running.file_stream(spark, f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sketches = ev.quantile_sketches(spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("date", F.to_date("ts")), ["value"], 64, by=["date"])
    levels = [0.25, 0.5, 0.75, 0.999]
    got = running.exact_quantiles(stream, sketches, levels, f"{tmp_path}/out", margin=margin).collect()
    values = sorted(r.value for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect())
    assert len(got) == 1 and got[0].q == [values[int(x * len(values)) - 1] for x in levels]


def test_ranks_of_targets_hold_one_cross_section(spark):
    from tidegrid.operators import xsection as xs

    df = spark.range(900).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.round(F.randn(2), 2)).alias("x"), F.lit(1.0).alias("c"), "id")
    got = xs.with_percentiles(df, {"p": "x", "q": "c"}, ["g"], 50, 1.5, sample_std=True)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {r.id: r.rank for r in xs.binned_percentile(df, "x", ["g"], 50, 1.5, sample_std=True).collect()}
    for r in got.collect():
        assert r.q == 0.5 and (r.p is None) == (want[r.id] is None) and (r.p is None or r.p == pytest.approx(want[r.id], abs=1e-9))


def test_a_days_median_is_counted_not_held(spark):
    from tidegrid.plans import evaluate as ev

    df = spark.range(400).select(F.lit(1).alias("date"), (F.col("id") % 4).alias("slot"), F.col("id").alias("instrument"), F.randn(1).alias("p"), F.randn(2).alias("h"))
    out = ev.daily_metrics(df, "p", ["h"], slot="slot", q=5, tops=(5,))
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_factors_run_over_bars_not_slots(spark):
    """Spans give what the grid gives, with missing prices and volumes too, and nothing is sorted or exchanged once the slots are laid out."""
    from tidegrid.plans import groups
    from tidegrid.plans.factors import compile_factors
    from tidegrid.sources import bars

    folder = "/root/testdata/sf0.001"
    hourly = bars.hourly_bars(spark, folder)
    hourly = hourly.withColumns({"volume": F.when(F.col("slot") % 5 != 2, F.col("volume")), "mid_price": F.when((F.col("slot") + F.col("instrument")) % 7 != 3, F.col("mid_price"))})
    daily = bars.dense_daily(bars.daily_panel(spark, folder))
    defs = groups.group("fg260114", windows=(1, 5))
    spans = bars._spans(hourly, bars.SLOTS)
    got = compile_factors(defs, daily, spans, bars.SLOTS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    slots = plan.index("Generate explode(sequence(_from")
    assert "Window" in plan[slots:] and not any(x in plan[:slots] for x in ("Window", "Exchange", "Sort"))
    want = {(r.date, r.instrument, r.slot): r for r in compile_factors(defs, daily, spans.grid(), bars.SLOTS).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and any(r.volume_today_std is None or r.volume_today_log_skewness is None for r in rows)
    for r in rows:
        other = want[r.date, r.instrument, r.slot]
        for a, b in zip(r, other, strict=True):
            assert (a is None) == (b is None) and (a is None or a == b or a == pytest.approx(b, abs=1e-9))


@pytest.mark.parametrize(("name", "moving"), [("default", 0), ("fg260113", 14), ("fg260114", 23)])
def test_few_factors_are_computed_slot_by_slot(spark, name, moving):
    from tidegrid.plans import groups
    from tidegrid.plans.factors import compiled
    from tidegrid.sources import bars

    spans = bars.intraday_spans(spark, "/root/testdata/sf0.001")
    c = compiled(groups.group(name), spans.columns, bars.SLOTS, spans.flows)
    assert c.plan.over_spans and sum(d.name in c.plan.nature for d in c.defs) == moving


def test_ranks_exchange_bars_not_slots(spark):
    """Ranks over spans are those over the grid, bars that stand for slots of several parts of a day included, and the slots are laid out behind the exchange."""
    from tidegrid.plans import groups
    from tidegrid.plans.factors import compile_factors
    from tidegrid.sources import bars

    folder = "/root/testdata/sf0.001"
    hourly = bars.hourly_bars(spark, folder)
    hourly = hourly.withColumns({"volume": F.when(F.col("slot") % 5 != 2, F.col("volume")), "mid_price": F.when((F.col("slot") + F.col("instrument")) % 7 != 3, F.col("mid_price"))})
    daily = bars.dense_daily(bars.daily_panel(spark, folder))
    defs = groups.group("lib")
    spans = bars._spans(hourly, bars.SLOTS)
    got = compile_factors(defs, daily, spans, bars.SLOTS, ranks=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(sequence(greatest")]
    want = {(r.date, r.instrument, r.slot): r for r in compile_factors(defs, daily, spans.grid(), bars.SLOTS, ranks=True).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and any(r.rank_price_dev_from_ma_10 is not None for r in rows)
    for r in rows:
        assert list(r) == [pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in want[r.date, r.instrument, r.slot]]


@pytest.mark.parametrize("name", ["default", "fg260114"])
def test_no_history_crosses_an_exchange(spark, name):
    """Bars go to the days, so that what is computed of hundreds of columns is exchanged, joined and sorted no more."""
    from tidegrid.plans import groups
    from tidegrid.plans.factors import compile_factors
    from tidegrid.sources import bars

    folder = "/root/testdata/sf0.001"
    made = compile_factors(groups.group(name), bars.dense_daily(bars.long_daily_panel(spark, folder)), bars.long_intraday_spans(spark, folder), bars.LONG_SLOTS)
    plan = made._jdf.queryExecution().executedPlan().toString()
    wide = plan[: plan.index("Union")]
    assert "Exchange" not in wide and "Join" not in wide
    assert wide.count("Sort [") == 1  # daily rows and bars of a day, side by side


def test_bars_meet_only_the_days_of_their_keys(spark):
    """Days without bars, bars without a day, and missing keys give no rows; a day's bars come back as they were."""
    from tidegrid.operators.spans import BARS, by_bar, by_day, with_bars

    daily = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0), (1, 2, None), (3, None, 5.0)], "date int, instrument int, x double")
    bars = spark.createDataFrame([(1, 1, 5, 0.5), (1, 1, 0, None), (1, 2, 3, 0.3), (9, 1, 0, 0.9), (3, None, 0, 0.1)], "date int, instrument int, slot int, v double")
    rows = by_bar(with_bars(daily, by_day(bars)).select("date", "instrument", "x", BARS)).collect()
    assert sorted(rows, key=lambda r: (r.instrument, r.slot)) == [(1, 1, 10.0, 0, None), (1, 1, 10.0, 5, 0.5), (1, 2, None, 3, 0.3)]


def test_partitions_of_panels_grow_with_their_tables(spark, tmp_path, monkeypatch):
    from tidegrid.operators import panel

    path = str(tmp_path / "t.parquet")
    spark.range(20000).select("id", F.rand(1).alias("x")).write.parquet(path)
    frame = spark.read.parquet(path).groupBy("id").agg(F.sum("x"))
    assert panel.by_size(frame) == 4
    monkeypatch.setattr(panel, "SHARE", 16 << 10)
    assert 8 < panel.by_size(frame) <= 32


def test_bars_take_turns_slot_by_slot(spark):
    """Each bar comes by once for each slot that it stands for, a date's slots one after the other, whatever gaps there are and however bars come in batches."""
    import random

    from tidegrid.operators.spans import TO, TURN, in_turn, laid_out

    draw = random.Random(5)
    spans = [(None if d == 4 else d, i, a, a + draw.randrange(4)) for d in range(5) for i in range(40) for a in (0, 6, 11) if d != 2 or (i < 3 and a != 6)]
    want = sorted(((d, s, i, a) for d, i, a, b in spans for s in range(a, b + 1)), key=str)
    frame = spark.createDataFrame(spans, f"date int, instrument int, slot int, {TO} int").repartition(3, "date")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        rows = in_turn(frame).collect()
        slots = [(r.date, r.slot, r.instrument, r._from) for r in laid_out(in_turn(frame), turns=True).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(((r.date, r[TURN], r.instrument, r.slot) for r in rows), key=str) == want == sorted(slots, key=str)
    order = [(r.date, r[TURN]) for r in rows]
    runs = [k for n, k in enumerate(order) if not n or k != order[n - 1]]
    assert len(runs) == len(set(runs))


@pytest.mark.parametrize("name", ["lib", "fg260114"])
def test_ranks_exchange_days_and_sort_bars(spark, name):
    """What is ranked comes by date as days with their bars, narrower than factors of bars; no slot is sorted."""
    from tidegrid.plans import groups
    from tidegrid.plans.factors import compile_factors
    from tidegrid.sources import bars

    folder = "/root/testdata/sf0.001"
    made = compile_factors(groups.group(name), bars.dense_daily(bars.daily_panel(spark, folder)), bars.intraday_spans(spark, folder), bars.SLOTS, ranks=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan[: plan.index("Generate explode(sequence(greatest")]
    behind = plan[: plan.index("Union")]
    assert behind.count("Exchange") == 1 and "Exchange hashpartitioning(date" in behind
    assert behind.index("Generate inline") < behind.index("Exchange")
