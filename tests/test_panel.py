"""Panel algebra on the sparse micro-panel: three instruments, five days, a hole in each."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import panel as pn


@pytest.fixture(scope="module")
def sparse(spark):
    day = lambda n: dt.date(2023, 1, n)
    holes = {"InstA": 2, "InstB": 3, "InstC": 1}
    base = {"InstA": (100.0, 1000.0), "InstB": (200.0, 2000.0), "InstC": (300.0, 3000.0)}
    rows = [(day(n), i, base[i][0] + n - 1, base[i][1] + 100.0 * (n - 1)) for i in base for n in range(1, 6) if n != holes[i]]
    return spark.createDataFrame(rows, "date date, instrument string, price double, volume double")


def cells(df, field):
    return {(r.instrument, r.date.day): r[field] for r in df.collect()}


def test_densify_fills_levels_forward_and_flows_with_zero(sparse):
    out = pn.densify(sparse)
    price, volume = cells(out, "price"), cells(out, "volume")
    assert len(price) == 15
    assert price["InstA", 2] == 100.0 and price["InstB", 3] == 201.0 and price["InstC", 1] is None
    assert volume["InstA", 2] == 0.0 and volume["InstC", 1] == 0.0


def test_densify_without_filling(sparse):
    assert cells(pn.densify(sparse, ffill=False), "price")["InstB", 3] is None


def test_backfill(sparse):
    out = pn.backfill(pn.densify(sparse), ["instrument"], "date", ["price"])
    assert cells(out, "price")["InstC", 1] == 301.0


def test_align_to_a_subset(sparse, spark):
    one = spark.createDataFrame([("InstA",)], "instrument string")
    assert set(cells(pn.densify(sparse, instruments=one), "price")) == {("InstA", n) for n in range(1, 6)}


def test_an_observed_gap_is_kept(spark):
    """A bar whose value is missing is filled forward as missing, not skipped."""
    rows = [(dt.date(2023, 1, 1), "a", 1.0), (dt.date(2023, 1, 2), "a", None), (dt.date(2023, 1, 3), "b", 5.0)]
    out = cells(pn.densify(spark.createDataFrame(rows, "date date, instrument string, price double")), "price")
    assert out["a", 3] is None and out["b", 3] == 5.0


def test_validity(sparse):
    gaps = pn.densify(sparse, ffill=False)
    assert {r.is_valid for r in pn.validity(gaps, ["price"], max_missing=2).collect()} == {True}
    assert {r.is_valid for r in pn.validity(gaps, ["price"], max_missing=1).collect()} == {False}


def test_adjusting(spark):
    rows = [(dt.date(2023, 1, n), "a", 10.0 * n, 100.0, f) for n, f in ((1, 1.0), (2, 1.0), (3, 2.0))]
    df = spark.createDataFrame(rows, "date date, instrument string, close double, volume double, factor double")
    last = {r.date.day: (r.adjusted_close, r.adjusted_volume) for r in pn.adjusted(df, ["close", "volume"]).collect()}
    assert last[1] == (20.0, 50.0) and last[3] == (30.0, 100.0)
    first = {r.date.day: (r.adjusted_close, r.adjusted_volume) for r in pn.adjusted(df, ["close", "volume"], last=False).collect()}
    assert first[3] == (15.0, 200.0)


def test_time_grid_has_238_slots(spark):
    grid = pn.time_grid(spark, "2024-03-01").collect()
    assert len(grid) == 238
    assert min(grid).datetime == dt.datetime(2024, 3, 1, 9, 25) and max(grid).datetime == dt.datetime(2024, 3, 1, 14, 56)


def test_normalize_finds_names_and_drops_nan(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1), "x", math.nan)], "timestamp timestamp, stock_code string, v double")
    row = pn.normalize(df).first()
    assert row.instrument == "x" and row.v is None
    with pytest.raises(ValueError):
        pn.normalize(df.drop("stock_code"))


def test_alignment_reports_absent_keys(sparse, spark):
    other = spark.createDataFrame([(dt.date(2030, 1, 1), "InstA")], "date date, instrument string")
    with pytest.raises(KeyError):
        pn.align(sparse, other)


def test_last_of_slot_wins(spark):
    df = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 2, 6.0)], "instrument string, slot int, n int, v double")
    assert pn.last_of_slot(df, ["instrument", "slot"], "n").first().v == 6.0


def test_filter_is_pushed_below_the_window(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).select(F.lit(dt.date(2023, 1, 1)).alias("date"), (F.col("id") % 5).alias("instrument"), F.rand(1).alias("price")).write.parquet(path)
    plan = pn.densify(spark.read.parquet(path), ffill=False).where("instrument = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(instrument), EqualTo(instrument,3)]" in plan


def test_order_within_partitions_and_valid_rows(spark):
    rows = [(dt.date(2024, 1, 1 + k % 5), k % 7, float(k) if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "date date, instrument int, close double").repartition(4)
    for by, key in (("datetime-first", ("date", "instrument")), ("instrument-first", ("instrument", "date"))):
        part = pn.in_order(df, by).withColumn("p", F.spark_partition_id()).collect()
        for n in {r.p for r in part}:
            own = [(r[key[0]], r[key[1]]) for r in part if r.p == n]
            assert own == sorted(own)
    assert pn.in_order(df, "none") is df
    # Dense to tidy: rows that hold a value.
    dense = pn.densify(df.where("close > 20"), ffill=False)
    assert {(r.date, r.instrument) for r in dense.where("close IS NOT NULL").collect()} == {(d, i) for d, i, c in rows if c is not None and c > 20}
