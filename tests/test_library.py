"""Ranks, statistics, sources, streams, models and pipelines."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.models import mlp
from tidegrid.operators import panel, windows
from tidegrid.operators import xsection as xs
from tidegrid.plans import evaluate as ev
from tidegrid.plans.neutral import Target, neutralize_missing
from tidegrid.plans.pipeline import Pipeline
from tidegrid.sources import walks
from tidegrid.sources.store import PanelStore, Variable
from tidegrid.streaming import running


def test_binned_percentile_is_near_the_exact_rank(spark):
    rng = np.random.default_rng(42)
    rows = [(g, i, float(x)) for g in range(4) for i, x in enumerate(rng.standard_t(3, 2000))]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    df = xs.exact_percentile(xs.binned_percentile(df, "x", ["g"], 4000, 4.0, name="p"), "x", ["g"], "r")
    assert df.agg(F.corr("p", "r")).first()[0] > 0.999
    assert df.where("abs(x) < 3").agg(F.avg(F.abs(F.col("p") - F.col("r")))).first()[0] < 0.001


def test_binned_percentile_of_gaps_and_constants(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, None)], "g int, x double")
    for sample in (True, False):
        got = [r["rank"] for r in xs.binned_percentile(df, "x", ["g"], sample_std=sample).collect()]
        assert sorted(got, key=str) == [0.5, 0.5, None]


def test_average_ranks_and_auc(spark):
    r = random.Random(1)
    rows = [(0, i, float(r.randint(0, 5)), r.choice([-1.0, 1.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, instrument int, p double, t double")
    pos, neg = [x[2] for x in rows if x[3] > 0], [x[2] for x in rows if x[3] <= 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert xs.auc(df, "p", "t", ["g"]).first().auc == pytest.approx(want)


def test_quantile_buckets_follow_the_edges(spark):
    n, q = 53, 10
    df = spark.createDataFrame([(0, i, float(i), float(i)) for i in range(n)], "g int, instrument int, p double, t double")
    got = {r.bucket: r.n for r in xs.quantile_stats(df, "p", "t", ["g"], q).collect()}
    edges = [n * i // q for i in range(q + 1)]
    assert got == {i: edges[i + 1] - edges[i] for i in range(q)}


def test_neutralising_agrees_with_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    y = x @ [0.5, -2.0] + 1 + rng.normal(size=80)
    df = spark.createDataFrame([(0, i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(80)], "g int, i int, y double, a double, b double")
    beta = np.linalg.lstsq(np.c_[np.ones(80), x], y, rcond=None)[0]
    for r in xs.neutralize(df, "y", ["a", "b"], ["g"], least=50).collect():
        assert r.residual == pytest.approx(y[r.i] - np.r_[1, x[r.i]] @ beta, abs=1e-9)
    assert xs.neutralize(df, "y", ["a", "b"], ["g"], least=500).count() == 0


def test_pair_loss(spark):
    r = random.Random(2)
    rows = [(0, i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(12)]
    want = [max(p - q, 0) + math.log1p(math.exp(-abs(p - q))) - (p - q) * (g - h > 0.001) for k, (_, _, p, g) in enumerate(rows) for (_, _, q, h) in rows[k + 1 :]]
    got = xs.pair_loss(spark.createDataFrame(rows, "g int, instrument int, p double, t double"), "p", "t", ["g"]).first()
    assert got.pairs == len(want) and got.loss == pytest.approx(sum(want) / len(want))


def test_ewma(spark):
    df = spark.createDataFrame([("a", n, v) for n, v in enumerate([1.0, 2.0, 4.0])], "k string, n int, x double")
    got = {r.n: r.ewma for r in windows.ewma(df, "x", 0.9, ["k"], "n").collect()}
    assert got[2] == pytest.approx(0.9 * (0.9 * 1 + 0.1 * 2) + 0.1 * 4)


def test_store_round_trip_and_missing_dates(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path))
    rows = [(dt.date(2024, 1, n), "a", s, 1.0) for n in (2, 3) for s in (0, 1)]
    df = spark.createDataFrame(rows, "date date, instrument string, slot int, volume double")
    store.save(Variable("quotation"), df)
    with pytest.raises(FileExistsError):
        store.save(Variable("quotation"), df)
    store.save(Variable("quotation"), df.where("date = '2024-01-02'").withColumn("volume", F.lit(5.0)), overwrite=True)
    got = {(r.date.day, r.slot): r.total_volume for r in store.quotation().collect()}
    assert got == {(2, 0): 5.0, (2, 1): 10.0, (3, 0): 1.0, (3, 1): 2.0}
    done = Variable("factor", "f")
    store.save(done, df.where("date = '2024-01-02'"))
    assert [r.date.day for r in store.todo([Variable("quotation")], done).collect()] == [3]
    assert store.dates(Variable("quotation"), Variable("prediction", "m")).count() == 0
    with pytest.raises(ValueError):
        store.path(Variable("nothing"))


def test_daily_slices_are_adjusted_as_of_the_day(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path))
    rows = [(dt.date(2024, 1, n), "a", 10.0, None, 0.5, f) for n, f in ((1, 1.0), (2, 2.0), (3, 4.0))]
    store.save(Variable("daily"), spark.createDataFrame(rows, "date date, instrument string, close double, alpha double, daily_return double, factor double"))
    assert {r.date.day: r.adjusted_close for r in store.daily_before("2024-01-02").collect()} == {1: 20.0}
    assert {r.date.day: r.adjusted_close for r in store.daily_after("2024-01-02").collect()} == {2: 10.0, 3: 5.0}
    assert store.daily().first().alpha == 0.5


def test_walks_are_reproducible(spark):
    a, b = (sorted(walks.random_walk(spark, steps=20, paths=3).collect()) for _ in range(2))
    assert a == b and all(r.price == 100.0 for r in a if r.step == 0)
    with pytest.raises(ValueError):
        walks.random_walk(spark, sigma=-1)


@pytest.mark.parametrize("kind", ["aggregate", "state"])
def test_stream_equals_batch(spark, tmp_path, kind):
    src = tmp_path / "src"
    rows = [(n, dt.datetime(2024, 1, 1 + n % 2, n % 20), n % 3, float(n)) for n in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.coalesce(1).write.parquet(str(src / "events.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    made = running.running_day(stream) if kind == "aggregate" else running.running_state(stream)
    out = running.run_to_table(made.select("date", "instrument", "n", "total", "high", "low"), str(tmp_path), "out", "update", ("date", "instrument"))
    want = df.groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("instrument")).agg(F.count("*"), F.sum("value"), F.max("value"), F.min("value"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_inference_equals_the_forward_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 6))
    w = mlp.init_weights(6, 3, gated=True)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "i long, f array<double>")
    want = mlp.residual_mlp(w, x)
    for r in mlp.predict(df, "f", w, ["i"], outputs=[0, 2]).collect():
        assert (r.pred_0, r.pred_2) == pytest.approx((want[r.i, 0], want[r.i, 2]))
    dual = mlp.predict(df, "f", {"first": w, "second": w, "compose": False}, ["i"], model="dual_mlp")
    assert {round(r.pred_1 - want[r.i, 1], 9) + round(r.pred_4 - want[r.i, 1], 9) for r in dual.collect()} == {0.0}
    gap = spark.createDataFrame([(0, [None, *[1.0] * 5])], "i long, f array<double>")
    assert mlp.predict(gap, "f", w, ["i"]).first().pred_0 is None


def norm(v, scale=None):
    m = sum(v) / len(v)
    var = sum((a - m) ** 2 for a in v) / len(v)
    return [(a - m) / math.sqrt(var + 1e-5) for a in v]


def layer(v, wb):
    return [sum(a * wb[0][i][j] for i, a in enumerate(v)) + wb[1][j] for j in range(len(wb[1]))]


def naive_tower(blocks, h):
    for b in blocks:
        z = h if b["post_norm"] else norm(h)
        up = layer(z, b["up"])
        if b["gate"] is not None:
            act = [g / (1 + math.exp(-g)) * u for g, u in zip(layer(z, b["gate"]), up, strict=True)]
        else:
            act = [0.5 * u * (1 + math.erf(u / math.sqrt(2))) for u in up]
        h = [a + c for a, c in zip(h, layer(act, b["down"]), strict=True)]
        h = norm(h) if b["post_norm"] else h
    return h


@pytest.mark.parametrize("kind", [{"gated": True}, {"post_norm": True, "final_norm": True}, {"input_norm": "layer", "position": 8}])
def test_networks_equal_a_forward_pass_by_hand(kind):
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(5, 4)), np.array([0.0, 3.0, 100.0, 200.0, 239.0])

    def by_hand(w, v, at):
        v = norm(v) if w.get("input_norm") is not None else v
        h = layer(v, w["in"])
        if w.get("position") is not None:
            steps = [at * math.exp(-i * math.log(500) / 8) for i in range(0, 8, 2)]
            h = [a + b for a, b in zip(h, layer([f(s) for s in steps for f in (math.sin, math.cos)], w["position"]), strict=True)]
        y = layer(naive_tower(w["blocks"], h), w["out"])
        return norm(y) if w.get("final_norm") is not None else y

    w = mlp.init_weights(4, 3, hidden=6, **kind)
    assert w["blocks"][0]["up"][0].shape == (6, 6)  # as wide as the network
    got = mlp.residual_mlp(w, x, t)
    assert got == pytest.approx(np.array([by_hand(w, list(v), at) for v, at in zip(x, t, strict=True)]), abs=1e-9)
    dual = mlp.init_dual(4, (3, 2), compose=True, hidden=6, **kind)
    y1, y2 = (np.array([by_hand(dual[k], list(v), at) for v, at in zip(x, t, strict=True)]) for k in ("first", "second"))
    p = t[:, None] / 240
    assert mlp.dual_mlp(dual, x, t) == pytest.approx(np.hstack([y1, y2, y1 + y2[:, :1] * np.hstack([p / 9, p / 6, p / 3])]), abs=1e-9)
    assert mlp.n_outputs(dual) == 8


def test_dual_heads_share_one_projection():
    x = np.random.default_rng(2).normal(size=(3, 4))
    w = mlp.init_dual_head(4, (2, 1), hidden=5, blocks=1)
    want = [[y for tower in w["towers"] for y in layer(naive_tower(tower["blocks"], layer(list(v), w["in"])), tower["out"])] for v in x]
    assert mlp.dual_head_mlp(w, x) == pytest.approx(np.array(want), abs=1e-9) and mlp.n_outputs(w) == 3


def test_error_function():
    x = np.linspace(-7, 7, 4001)
    assert np.abs(mlp.erf_of(x) - np.array([math.erf(v) for v in x])).max() < 1e-11


def test_neutralising_on_many_and_on_singular_regressors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4))
    x[:, 3] = x[:, 0] + x[:, 1]  # singular
    y = x[:, :3] @ [1.0, -1.0, 2.0] + rng.normal(size=90)
    df = spark.createDataFrame([(i % 2, i, float(y[i]), *map(float, x[i])) for i in range(90)], "g int, i int, y double, a double, b double, c double, d double")
    for r in xs.neutralize(df, "y", ["a", "b", "c", "d"], ["g"], least=10, share=0.7).collect():
        mine = np.arange(90) % 2 == r.g
        design = np.c_[np.ones(45), x[mine]]
        fitted = np.r_[1, x[r.i]] @ np.linalg.lstsq(design, y[mine], rcond=None)[0]
        assert r.residual == pytest.approx(y[r.i] - 0.7 * fitted, abs=1e-8)
        assert r.corr_b == pytest.approx(np.corrcoef(x[mine, 1], y[mine])[0, 1])
    for r in xs.neutralize(df, "y", ["a", "b"], ["g"], least=10, nonpositive=True).collect():
        mine = np.arange(90) % 2 == r.g
        beta = np.minimum(np.linalg.lstsq(np.c_[np.ones(45), x[mine, :2]], y[mine], rcond=None)[0], 0)
        assert r.residual == pytest.approx(y[r.i] - np.r_[1, x[r.i, :2]] @ beta, abs=1e-8)
    plain = xs.betas(df, "y", ["a"], ["g"], least=10, intercept=False).collect()
    assert all(r.intercept == 0 and r.beta_a == pytest.approx((x[np.arange(90) % 2 == r.g, 0] @ y[np.arange(90) % 2 == r.g]) / (x[np.arange(90) % 2 == r.g, 0] ** 2).sum()) for r in plain)


def test_neutralising_only_missing_dates(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path))
    rng = np.random.default_rng(5)
    rows = [(dt.date(2024, 1, n), i, s, float(rng.normal()), float(rng.normal())) for n in (2, 3) for i in range(12) for s in (0, 1)]
    base = spark.createDataFrame(rows, "date date, instrument int, slot int, f double, pred_0 double")
    store.save(Variable("quotation"), base.drop("pred_0"))
    store.save(Variable("prediction", "m"), base.drop("f"))
    inputs, dependents, out = Variable("quotation", fields=("f",)), Variable("prediction", "m", fields=("pred_0",)), Variable("prediction", "m.n")
    store.save(out, base.where("date = '2024-01-02'").select("date", "instrument", "slot", F.lit(7.0).alias("pred_0")))
    means = neutralize_missing(store, [inputs], [dependents], out, [Target("pred_0", "pred_0"), Target("pred_0", "kept", intercept=False, share=0.0)], least=5)
    assert [r.date.day for r in means.collect()] == [3]
    got = store.load(out)
    assert {r.pred_0 for r in got.where("date = '2024-01-02'").collect()} == {7.0}
    new = got.where("date = '2024-01-03'").collect()
    assert len(new) == 24 and abs(sum(r.pred_0 for r in new if r.slot == 0)) < 1e-9


def test_predictions_meet_their_quotation(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path))
    rows = [(dt.date(2024, 1, 2), "a", s, float(s)) for s in range(3)]
    store.save(Variable("quotation"), spark.createDataFrame(rows[:2], "date date, instrument string, slot int, price double"))
    v = Variable("prediction", "m", 3, True)
    store.save(v, spark.createDataFrame(rows, "date date, instrument string, slot int, pred_0 double"))
    assert store.path(v).endswith("prediction/m/epoch03_ema")
    assert {r.slot: r.price for r in store.prediction_with_quotation(v).collect()} == {0: 0.0, 1: 1.0, 2: None}


def test_sketches_merge_and_stay_near_the_exact_quantiles(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("day"), F.rand(3).alias("v"))
    days = ev.quantile_sketches(df, ["v"], 2000, by=["day"])
    for r in ev.sketch_quantiles(ev.merged(days), (0.9, 0.99, 0.999)).collect():
        assert r.upper == pytest.approx(r.level, abs=0.005) and r.lower == pytest.approx(1 - r.level, abs=0.005)
    exact = {(r.horizon, r.level): r.upper for r in ev.exact_tails(df, ["v"], (0.9,)).collect()}
    assert exact["v", 0.9] == pytest.approx(0.9, abs=0.005)


def test_draws_differ_by_day_and_follow_the_selector(spark):
    df = spark.sql("SELECT date_add(DATE'2024-01-01', int(d)) date, concat('i', i) instrument, s slot, s % 2 = 0 good FROM range(20) a(d), range(10) b(i), range(24) c(s)")
    rows = panel.one_random_slot(df, 5, period=(6, 18)).collect()
    assert len(rows) == 200 and all(6 <= r.slot < 18 and r.position == (r.slot - 6) * 20 for r in rows)
    assert len({r.slot for r in rows if r.instrument == "i3"}) > 5  # not one slot for all days
    assert sorted(rows) == sorted(panel.one_random_slot(df.repartition(3), 5, period=(6, 18)).collect())
    kept = panel.one_random_slot(df, 5, period=(6, 18), selector=F.col("good")).collect()
    assert sorted(kept) == sorted(r for r in rows if r.good)


def test_gaps_fail_a_sequence_batch(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, float("nan"))], "i int, x double, y double")
    assert panel.without_gaps(df.where("i = 1"), ["x", "y"]).count() == 1
    with pytest.raises(Exception, match="missing value"):
        panel.without_gaps(df, ["x", "y"]).collect()
    assert [r.x for r in panel.trailing(df.withColumn("instrument", F.lit("a")), "i", 2, 1).collect()] == [3.0]


def test_state_of_a_decayed_average_survives_batches(spark, tmp_path):
    rows = [(n, k, float(n * k)) for n in range(1, 7) for k in (1, 2)]
    for part in (rows[:4], rows[4:8], rows[8:]):
        spark.createDataFrame(part, "day int, k int, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = running.run_to_table(running.decayed(running.file_stream(spark, str(tmp_path / "in")), "x", 0.9, ("k",), "day"), str(tmp_path), "out", "update", ("k",))
    for r in out.collect():
        want = float(r.k)
        for n in range(2, 7):
            want = 0.9 * want + 0.1 * n * r.k
        assert r.day == 6 and r.ewma == pytest.approx(want)


def test_sequence_pair_loss(spark):
    r = random.Random(9)
    rows = [(0, i, s, r.gauss(0, 1), r.gauss(0, 1), r.random() < 0.7) for i in range(8) for s in range(3)]
    df = spark.createDataFrame(rows, "g int, instrument int, slot int, p double, t double, m boolean").withColumn("m", F.col("m").cast("int"))
    want = [max(a[3] - b[3], 0) + math.log1p(math.exp(-abs(a[3] - b[3]))) - (a[3] - b[3]) * (a[4] - b[4] > 0.001) for a in rows for b in rows if a[1] < b[1] and a[2] == b[2] and a[5] and b[5]]
    got = xs.sequence_pair_loss(df, "p", "t", "m", ["g"], "slot").first()
    assert got.pairs == len(want) and got.loss == pytest.approx(sum(want) / len(want), rel=1e-6)


def test_sample_minutes():
    marks = panel.sample_minutes()
    assert marks[:12] == [*range(10), 10, 12] and marks[-1] == 239 and len(marks) == len(set(marks))


def test_pipeline_checks_names(spark):
    p = Pipeline(["a"]).add(lambda a: a.withColumn("x", F.lit(1)), ["a"], "b")
    with pytest.raises(ValueError):
        p.add(lambda c: c, ["c"], "d")
    with pytest.raises(ValueError):
        p.add(lambda a: a, ["a"], "b")
    assert p.run(a=spark.range(3))["b"].count() == 3


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len([n for n in q if not n.startswith("op")]) > 100
