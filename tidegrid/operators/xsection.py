"""Cross-sections: ranks, correlations, bucket statistics and neutralisation by group.

Everything is grouped by `by` (usually the date or the time), so one exchange on it serves all. The
aggregates combine before the shuffle; the ranks need a group's rows together, which is one
cross-section of instruments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.panel import partitions


def average_rank(df: DataFrame, x: str, by: Sequence[str], name: str) -> DataFrame:
    """Rank from 1 with ties averaged; missing values get none."""
    w = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    ties = Window.partitionBy(*by, x)
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0))


def position_rank(x: str, by: Sequence[str], tie: str, descending: bool = False) -> Column:
    """Rank from 1 without ties."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, tie))


def exact_percentile(df: DataFrame, x: str, by: Sequence[str], name: str = "rank") -> DataFrame:
    """(average rank - 0.5) / n."""
    n = F.count(x).over(Window.partitionBy(*by))
    return average_rank(df, x, by, "_r").withColumn(name, (F.col("_r") - 0.5) / n).drop("_r")


def binned_percentile(df: DataFrame, x: str, by: Sequence[str], bins: int = 1024, sigmas: float = 3.0, sample_std: bool = False, name: str = "rank") -> DataFrame:
    """Approximate percentile from a histogram between mean +- sigmas standard deviations.

    With sample_std the values outside the bounds are counted beside the bins (and a constant
    cross-section is 0.5); otherwise they are clamped into the edge bins. Two windows over one exchange:
    the moments, then running bin counts.
    """
    group = Window.partitionBy(*by)
    v = F.col(x)
    n = F.count(v).over(group)
    sd = (F.stddev_samp if sample_std else F.stddev_pop)(v).over(group)
    df = df.withColumns({"_n": n, "_mu": F.avg(v).over(group), "_sd": sd})
    low, high = F.col("_mu") - F.col("_sd") * sigmas, F.col("_mu") + F.col("_sd") * sigmas
    flat = F.coalesce(F.col("_sd") < 1e-12, F.lit(True))
    place = F.when(~flat, F.try_divide((v - low) * bins, high - low))
    inside = F.greatest(F.least(F.floor(place), F.lit(bins - 1)), F.lit(0))
    if sample_std:
        inside = F.when(v <= low, F.lit(-1)).when(v >= high, F.lit(bins)).otherwise(inside)
    df = df.withColumns({"_flat": flat, "_low": v <= low, "_high": v >= high, "_place": place, "_bin": inside.cast("long")})
    upto = F.count(v).over(group.orderBy("_bin").rangeBetween(Window.unboundedPreceding, 0)) if not by else F.count(v).over(Window.partitionBy(*by).orderBy("_bin").rangeBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"_upto": upto, "_here": F.count(v).over(Window.partitionBy(*by, "_bin"))})
    inner = ((F.col("_upto") - F.col("_here")) + F.col("_here") * (F.col("_place") - F.col("_bin"))) / F.col("_n")
    value = F.when(v.isNull(), None).when(F.col("_flat"), 0.5).when(F.col("_low"), 0.0).when(F.col("_high"), 1.0).otherwise(inner)
    return df.withColumn(name, value).drop("_n", "_mu", "_sd", "_flat", "_low", "_high", "_place", "_bin", "_upto", "_here")


def _histogram_percentile(x: np.ndarray, bins: int, sigmas: float, sample_std: bool = False) -> np.ndarray:
    """binned_percentile of a column of a cross-section (NaN where missing)."""
    there = ~np.isnan(x)
    v = x[there]
    out, n = np.full(len(x), np.nan), len(v)
    if not n:
        return out
    mean = v.sum() / n
    sd = np.sqrt(((v - mean) ** 2).sum() / (n - 1)) if sample_std and n > 1 else 0.0 if sample_std else np.sqrt(((v - mean) ** 2).sum() / n)
    if not sd >= 1e-12:
        out[there] = 0.5
        return out
    low, high = mean - sd * sigmas, mean + sd * sigmas
    place = (v - low) * bins / (high - low)
    # Rounded first, so that the bin of ties at an edge doesn't hang on the order in which sums were taken.
    at = np.clip(np.floor(np.round(place, 6)), 0, bins - 1).astype(np.int64)
    below, above = v <= low, v >= high
    counts = np.bincount(at[~(below | above)] if sample_std else at, minlength=bins)
    inner = ((counts.cumsum() - counts)[at] + counts[at] * (place - at) + (below.sum() if sample_std else 0)) / n
    out[there] = np.where(below, 0.0, np.where(above, 1.0, inner))
    return out


def ranked_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str], bins: int = 2000, sigmas: float = 3.5, prefix: str = "rank_", in_order: bool = False) -> DataFrame:
    """Adds rank_x = 4 p - 2 for each column, p its binned percentile among the rows of the same `by`."""
    return with_percentiles(df, {f"{prefix}{c}": c for c in columns}, by, bins, sigmas, scale=4.0, shift=2.0, in_order=in_order)


def with_percentiles(df: DataFrame, columns: Mapping[str, str], by: Sequence[str], bins: int, sigmas: float, sample_std: bool = False, scale: float = 1.0, shift: float = 0.0, in_order: bool = False) -> DataFrame:
    """Adds each named column: scale p - shift, p the binned percentile of the column it is of among the rows of the same `by`.

    All columns are ranked after one exchange and one sort on `by`: the cross-sections go by as a stream, a task holds one of
    them and the histogram of one column. A window for each column would sort and copy the rows once a column, and hold the
    cross-section once a window. The exchange has more partitions than others, as its rows are wide: what a task sorts
    should not spill. Other columns go along. in_order: the rows of one `by` follow each other already, and nothing is exchanged or sorted.
    """
    schema = ", ".join([f"`{c}` {kind}" for c, kind in df.dtypes] + [f"`{c}` double" for c in columns])

    def ranked(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for name, c in columns.items():
            x = np.concatenate([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for b in rows])
            made[name] = scale * _histogram_percentile(x, bins, sigmas, sample_std) - shift
        first = 0
        for b in rows:
            parts = [pa.array(x[first : first + b.num_rows], pa.float64(), from_pandas=True) for x in made.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *parts], [*b.schema.names, *made])
            first += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in by]
            edges = np.flatnonzero(reduce(np.logical_or, [k[1:] != k[:-1] for k in codes])) + 1
            same = bool(held) and all(held[-1].column(c)[-1].as_py() == b.column(c)[0].as_py() for c in by)
            if held and not same:
                yield from ranked(held)
                held = []
            for first, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                held.append(b.slice(first, end - first))
                if end < b.num_rows:
                    yield from ranked(held)
                    held = []
        if held:
            yield from ranked(held)

    ordered = df if in_order else df.repartition(8 * partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, schema)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of a group's pairs; NULL where either doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def both(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def ic(df: DataFrame, pred: str, gt: str, by: Sequence[str], least: int = 20) -> DataFrame:
    """Pearson correlation over the pairs without gaps; NULL under `least` pairs."""
    pairs = df.where(both(pred, gt))
    agg = pairs.groupBy(*by).agg(F.count("*").alias("n"), correlation(pred, gt).alias("_ic"), F.stddev_pop(pred).alias("_a"), F.stddev_pop(gt).alias("_b"))
    return df.select(*by).distinct().join(agg, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") >= least) & (F.col("_a") > 0) & (F.col("_b") > 0), F.col("_ic")).alias("ic"))


def rank_ic(df: DataFrame, pred: str, gt: str, by: Sequence[str], tie: str = "instrument", scaled: bool = True) -> DataFrame:
    """Correlation of position ranks; scaled: times (n - 1) / n, as the metric of that name has it."""
    ranked = df.where(both(pred, gt)).select(*by, position_rank(pred, by, tie).alias("_p"), position_rank(gt, by, tie).alias("_g"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col("_p").cast("double"), F.col("_g").cast("double")).alias("_c"))
    return out.select(*by, "n", F.when(F.col("n") >= 2, F.col("_c") * ((F.col("n") - 1) / F.col("n") if scaled else F.lit(1.0))).alias("rank_ic"))


def top_share(df: DataFrame, pred: str, gt: str, by: Sequence[str], share: float, tie: str = "instrument") -> DataFrame:
    """Pairs without gaps with _top (rank from the top), _low (from the bottom), _n and _k = floor(n share)."""
    pairs = df.where(both(pred, gt))
    n = F.count("*").over(Window.partitionBy(*by))
    return pairs.select(*by, tie, pred, gt, position_rank(pred, by, tie, True).alias("_top"), position_rank(pred, by, tie).alias("_low"), n.alias("_n")).withColumn("_k", F.floor(F.col("_n") * share))


def long_rank_ic(df: DataFrame, pred: str, gt: str, by: Sequence[str], share: float = 0.5, tie: str = "instrument") -> DataFrame:
    """rank_ic among the top share by prediction; 0 where that is under two."""
    top = top_share(df, pred, gt, by, share, tie).where("_top <= _k")
    got = rank_ic(top, pred, gt, by, tie)
    every = df.select(*by).distinct()
    return every.join(got, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("k"), F.coalesce("rank_ic", F.lit(0.0)).alias("long_ic"))


def long_ic(df: DataFrame, pred: str, gt: str, by: Sequence[str], quantile: float, least: int = 20) -> DataFrame:
    """ic over the rows whose prediction is at or over its quantile."""
    bound = F.percentile(pred, F.lit(quantile)).over(Window.partitionBy(*by))
    return ic(df.where(both(pred, gt)).withColumn("_q", bound).where(F.col(pred) >= F.col("_q")), pred, gt, by, least)


def hit_rate(df: DataFrame, pred: str, gt: str, by: Sequence[str], share: float = 0.5) -> DataFrame:
    """How often (pred over its 1 - share quantile) agrees with (gt > 0)."""
    bound = F.percentile(pred, F.lit(1 - share)).over(Window.partitionBy(*by))
    pairs = df.where(both(pred, gt)).withColumn("_q", bound)
    return pairs.groupBy(*by).agg(F.avg(((F.col(pred) > F.col("_q")) == (F.col(gt) > 0)).cast("double")).alias("hit_rate"))


def auc(df: DataFrame, pred: str, gt: str, by: Sequence[str], least: int = 20) -> DataFrame:
    """Mann-Whitney area with ties averaged for the label gt > 0."""
    ranked = average_rank(df.where(both(pred, gt)), pred, by, "_r")
    up = F.col(gt) > 0
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(up, F.col("_r"))).alias("r"), F.count_if(up).alias("p"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * (F.col("n") - F.col("p")))
    return sums.select(*by, "n", F.when((F.col("n") >= least) & (F.col("p") > 0) & (F.col("p") < F.col("n")), value).alias("auc"))


def quantile_stats(df: DataFrame, pred: str, gt: str, by: Sequence[str], q: int = 10, tie: str = "instrument", least: int | None = None) -> DataFrame:
    """by, bucket (0 to q - 1), n, mean: equal-count buckets with edges floor(n i / q), for groups of at least max(50, 5 q) rows."""
    least = max(50, 5 * q) if least is None else least
    pairs = df.where(both(pred, gt))
    ranked = pairs.select(*by, gt, (position_rank(pred, by, tie) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    bucket = F.floor(((F.col("_i") + 1) * q - 1) / F.col("_n")).cast("long")  # the last b with floor(n b / q) <= i
    return ranked.where(F.col("_n") >= least).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(gt).alias("mean"))


def quantile_summary(df: DataFrame, pred: str, gt: str, by: Sequence[str], q: int = 10, tops=(5, 10), tie: str = "instrument", least: int | None = None) -> DataFrame:
    """spread, monotonicity (Spearman of bucket and mean), tail (top minus bottom 1 %), and means of the top rows."""
    least = max(50, 5 * q) if least is None else least
    buckets = quantile_stats(df, pred, gt, by, q, tie, least)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("mean", "bucket")).cast("double")
    b = buckets.withColumn("_r", rank).groupBy(*by).agg(
        (F.max_by("mean", "bucket") - F.min_by("mean", "bucket")).alias("spread"), correlation(F.col("bucket").cast("double"), "_r").alias("monotonicity")
    )
    t = top_share(df, pred, gt, by, 0.01, tie).where(F.col("_n") >= least).withColumn("_k", F.greatest(F.lit(1), F.round(F.col("_n") * 0.01)))
    mean = lambda c: F.avg(F.when(c, F.col(gt)))
    tails = t.groupBy(*by).agg(
        (mean(F.col("_top") <= F.col("_k")) - mean(F.col("_low") <= F.col("_k"))).alias("tail"), *[mean(F.col("_top") <= k).alias(f"top_{k}") for k in tops]
    )
    return b.join(tails, list(by))


def value_buckets(df: DataFrame, pred: str, gt: str, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """by, bucket, n, mean by half-open bins of the z-score; bucket i holds edges[i-1] <= z < edges[i]."""
    w = Window.partitionBy(*by)
    pairs = df.where(both(pred, gt))
    z = F.try_divide(F.col(pred) - F.avg(pred).over(w), F.stddev_pop(pred).over(w))
    number = reduce(lambda a, e: a + F.when(F.col("_z") >= e, 1).otherwise(0), edges, F.lit(0)).cast("long")
    return pairs.withColumn("_z", z).where("_z IS NOT NULL").groupBy(*by, number.alias("bucket")).agg(F.count("*").alias("n"), F.avg(gt).alias("mean"))


def tiered_returns(df: DataFrame, pred: str, gt: str, by: Sequence[str], share: float = 0.1, tie: str = "instrument") -> DataFrame:
    """Mean outcome of the top and bottom k = floor(n share), and their spread; 0 where k is 0."""
    t = top_share(df, pred, gt, by, share, tie)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col(gt))), F.lit(0.0))
    top, low = mean(F.col("_top") <= F.col("_k")), mean(F.col("_low") <= F.col("_k"))
    return t.groupBy(*by).agg(top.alias("top"), low.alias("bottom"), (top - low).alias("spread"))


def precision(df: DataFrame, pred: str, gt: str, by: Sequence[str], share: float = 0.1, tie: str = "instrument") -> DataFrame:
    t = top_share(df, pred, gt, by, share, tie)
    return t.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("_top") <= F.col("_k"), (F.col(gt) > 0).cast("double"))), F.lit(0.0)).alias("precision"))


def coverage(df: DataFrame, pred: str, gt: str, by: Sequence[str]) -> DataFrame:
    """coverage = mean(gt < |pred|), interval_width = mean |pred|."""
    return df.where(both(pred, gt)).groupBy(*by).agg(F.avg((F.col(gt) < F.abs(pred)).cast("double")).alias("coverage"), F.avg(F.abs(pred)).alias("interval_width"))


#: Upper edges of the whole-sample quantile bins: hundredths, then the far tail.
TAIL_EDGES = (0.995, 0.999, 0.9995, 0.9999)


def quantile_bin(p: Column) -> Column:
    """0 to 98 by hundredths, then five bins of the last hundredth; NULL stays."""
    tail = reduce(lambda a, e: a + F.when(p >= e, 1).otherwise(0), TAIL_EDGES, F.lit(99))
    return F.when(p < 0.99, F.floor(p * 100)).otherwise(F.when(p.isNotNull(), tail)).cast("long")


def quantile_accumulator(df: DataFrame, p: str, gts: Sequence[str]) -> DataFrame:
    """horizon, bin, n, total, mean over everything: additive, so parts and streams can be summed up."""
    long = df.select(quantile_bin(F.col(p)).alias("bin"), F.explode(F.array(*[F.struct(F.lit(g).alias("horizon"), F.col(g).alias("v")) for g in gts])).alias("s")).select("bin", "s.horizon", "s.v")
    return long.where("bin IS NOT NULL AND v IS NOT NULL").groupBy("horizon", "bin").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"))


def newey_west(df: DataFrame, x: str, time: str, lag: int = 5, least: int = 10) -> DataFrame:
    """n, mean, t: the mean's t-statistic with Bartlett weights. One series of dates, so one ordered window is enough."""
    s = df.where(F.col(x).isNotNull()).select(time, F.col(x).alias("x"))
    mean = s.agg(F.avg("x").alias("_m"))
    w = Window.orderBy(time)
    c = s.join(F.broadcast(mean), how="cross").withColumn("c", F.col("x") - F.col("_m"))
    lagged = c.select("x", "c", *[F.lag("c", j).over(w).alias(f"c{j}") for j in range(1, lag + 1)])
    agg = lagged.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum(F.col("c") * F.col("c")).alias("g0"), *[F.coalesce(F.sum(F.col("c") * F.col(f"c{j}")), F.lit(0.0)).alias(f"g{j}") for j in range(1, lag + 1)])
    spread = reduce(lambda a, j: a + 2 * (1 - j / (lag + 1)) * F.col(f"g{j}"), range(1, lag + 1), F.col("g0")) / F.col("n")
    return agg.select("n", "mean", F.when((F.col("n") >= least) & (spread > 0), F.col("mean") / F.sqrt(spread / F.col("n"))).alias("t"))


def solved(moments: DataFrame, by: Sequence[str], k: int, intercept: bool, nonpositive: bool) -> DataFrame:
    """by, _n, _base and arrays _beta, _corr: least squares from a group's mean values and covariances, one small system a group.

    A singular system gets its solution of least norm. nonpositive: coefficients over zero become zero.
    """
    kinds = dict(moments.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            column = lambda c: np.asarray(batch.column(c), dtype=np.float64)
            mean = np.stack([column(f"_m{i}") for i in range(k + 1)], axis=1)
            cov = np.empty((n, k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    cov[:, i, j] = cov[:, j, i] = column(f"_s{i}_{j}")
            gram = cov if intercept else cov + mean[:, :, None] * mean[:, None, :]
            size = np.sqrt(np.maximum(np.diagonal(gram, axis1=1, axis2=2)[:, 1:], 0.0))  # regressors of unlike sizes are put on one scale
            size[size == 0] = 1.0
            scaled = gram[:, 1:, 1:] / (size[:, :, None] * size[:, None, :])
            beta = (np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) @ (gram[:, 1:, :1] / size[:, :, None]))[:, :, 0] / size if n else np.empty((0, k))
            base = mean[:, 0] - (beta * mean[:, 1:]).sum(axis=1) if intercept else np.zeros(n)
            with np.errstate(divide="ignore", invalid="ignore"):
                corr = cov[:, 1:, 0] / np.sqrt(cov[:, 0, 0][:, None] * np.diagonal(cov, axis1=1, axis2=2)[:, 1:])
            if nonpositive:
                beta, base = np.minimum(beta, 0.0), np.minimum(base, 0.0)
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (beta, np.where(np.isfinite(corr), corr, np.nan))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("_n"), pa.array(base), *lists], [*by, "_n", "_base", "_beta", "_corr"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_n long, _base double, _beta array<double>, _corr array<double>"])
    return moments.mapInArrow(run, schema)


def betas(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], least: int = 500, intercept: bool = True, nonpositive: bool = False) -> DataFrame:
    """by, n, intercept, beta_x and corr_x for each regressor: a fit of y on xs in each group of at least `least` rows without gaps.

    Counts, means and covariances are one aggregate, combined before the exchange; no group is gathered.
    """
    cols = [y, *xs]
    pairs = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    sums = [F.covar_pop(cols[i], cols[j]).alias(f"_s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    moments = pairs.groupBy(*by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)], *sums).where(F.col("_n") >= least)
    fit = solved(moments, by, len(xs), intercept, nonpositive)
    return fit.select(
        *by, F.col("_n").alias("n"), F.col("_base").alias("intercept"), *[F.get("_beta", F.lit(i)).alias(f"beta_{x}") for i, x in enumerate(xs)], *[F.nanvl(F.get("_corr", F.lit(i)), F.lit(None)).alias(f"corr_{x}") for i, x in enumerate(xs)]
    )


def neutralize(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], least: int = 500, intercept: bool = True, nonpositive: bool = False, share: float = 1.0) -> DataFrame:
    """Rows without gaps with the betas, correlations and `residual` = y - share * (X beta), of groups with at least `least` rows.

    The fit has a row for each group and is joined back on it; the rows are read once more, not exchanged
    while the fit is small enough to be broadcast.
    """
    fit = betas(df, y, xs, by, least, intercept, nonpositive)
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *xs)]))
    out = rows.join(fit.drop("n"), list(by))
    fitted = reduce(lambda a, x: a + F.col(f"beta_{x}") * F.col(x), xs, F.col("intercept"))
    return out.withColumn("residual", F.col(y) - share * fitted).drop("intercept")


#: Rows of a block: two blocks meet at a time, in work of n log n.
PAIR_BLOCK = 1 << 16
#: Width of the cells of predictions, and degree of the expansions between two cells: the remainder is under 1e-14.
_CELL, _DEGREE = 0.5, 18


def _even_sum(p: np.ndarray, q: np.ndarray) -> float:
    """Sum of ln(2 cosh((p_i - q_j) / 2)) over all i and j, by the moments of cells: no pair is formed."""

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.floor(x / _CELL), return_inverse=True)
        centre, t = (found + 0.5) * _CELL, np.ones(len(x))
        off, out = x - centre[at], []
        for k in range(_DEGREE + 1):
            out.append(np.bincount(at, t, len(found)))
            t = t * off / (k + 1)
        return centre, np.stack(out)  # sums of off^k / k!

    (a, m), (b, w) = cells(p), cells(q)
    total = 0.0
    for i in range(len(a)):
        far = a[i] - b
        # Taylor coefficients of tanh(x / 2) / 2, whose derivative is 1/4 - its square, and of its integral.
        y = [np.tanh(far / 2) / 2]
        for n in range(_DEGREE):
            y.append((0.25 * (n == 0) - sum(y[k] * y[n - k] for k in range(n + 1))) / (n + 1))
        c = np.abs(far) / 2 + np.log1p(np.exp(-np.abs(far)))
        for n in range(_DEGREE + 1):
            power = sum(m[k, i] * w[n - k] * (-1) ** (n - k) for k in range(n + 1)) * math.factorial(n)
            total += float((c * power).sum())
            c = y[n] / (n + 1)
    return total


def _ordered_pairs(p: np.ndarray, g: np.ndarray, own: np.ndarray, crossing: bool, margin: float) -> tuple[int, float]:
    """Number and loss of the pairs of an earlier and a later row; crossing: of those with unlike `own` alone.

    The loss is d / 2 + ln(2 cosh(d / 2)) - d [g_i - g_j > margin]: the first part follows from the number of later and earlier
    partners, the second does not hang on order, the third is counted by merging halves sorted by g.
    """
    n, sides = len(p), ((~own, own) if crossing else (np.ones(len(p), bool),))
    partners = list(zip(sides, sides[::-1], strict=True))
    pairs, total = 0, 0.0
    for mine, other in partners:
        behind = other.sum() - np.cumsum(other)
        before = np.cumsum(other) - other
        pairs += int(behind[mine].sum())
        total += float((p * (behind - before))[mine].sum()) / 2
    total += _even_sum(p[~own], p[own]) if crossing else (_even_sum(p, p) - n * math.log(2.0)) / 2
    values, rank = np.unique(g, return_inverse=True)
    under = np.searchsorted(values, g - margin)
    while True:  # g_i - g_j > margin as doubles have it
        up = (under < len(values)) & (g - values[np.minimum(under, len(values) - 1)] > margin)
        down = (under > 0) & ~(g - values[np.maximum(under - 1, 0)] > margin)
        if not (up | down).any():
            break
        under = under + up - (down & ~up)
    place, half = np.arange(n), 1
    while half < n:
        part = place // half
        part, left = part >> 1, part % 2 == 0
        key = part * (len(values) + 1)
        right = np.flatnonzero(~left)
        right = right[np.argsort(key[right] + rank[right], kind="stable")]
        keys, asked = (key + rank)[right], np.flatnonzero(left)
        first, end = np.searchsorted(keys, key[asked]), np.searchsorted(keys, key[asked] + under[asked])
        for mine, other in partners:
            count, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (other[right].astype(np.int64), np.where(other, p, 0.0)[right]))
            take = mine[asked]
            total -= float((p[asked] * (count[end] - count[first]) - (sums[end] - sums[first]))[take].sum())
        half *= 2
    return pairs, total


def _every_pair(i: np.ndarray, p: np.ndarray, g: np.ndarray, own: np.ndarray, crossing: bool, margin: float, rows: int = 256) -> tuple[int, float]:
    """_pair_sum pair by pair, some rows at a time: for blocks with infinite or undefined values, whose sums don't come apart."""
    n, total = 0, 0.0
    with np.errstate(invalid="ignore"):
        for a in range(0, len(i), rows):
            at = slice(a, a + rows)
            d, met = p[at, None] - p[None, :], i[at, None] < i[None, :]
            met = met & (own[at, None] != own[None, :]) if crossing else met
            loss = np.maximum(d, 0.0) + np.log1p(np.exp(-np.abs(d))) - d * (g[at, None] - g[None, :] > margin)
            n, total = n + int(met.sum()), total + float(loss[met].sum())
    return n, total


def _pair_sum(i: np.ndarray, p: np.ndarray, g: np.ndarray, own: np.ndarray, crossing: bool, margin: float) -> tuple[int, float]:
    """Number and loss of the pairs with i < j; crossing: one row of each block."""
    order = np.argsort(i, kind="stable")
    i, p, g, own = i[order], p[order], g[order], own[order]
    if not (np.isfinite(p).all() and np.isfinite(g).all()):
        return _every_pair(i, p, g, own, crossing, margin)
    pairs, total = _ordered_pairs(p, g, own, crossing, margin)
    # Rows of one place in the order are no pair.
    edges = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            k, loss = _ordered_pairs(p[a:b], g[a:b], own[a:b], crossing, margin)
            pairs, total = pairs - k, total - loss
    return pairs, total


def block_pairs(df: DataFrame, pred: str, gt: str, by: Sequence[str], order: str = "instrument", margin: float = 0.001, block: int = PAIR_BLOCK) -> DataFrame:
    """by, pairs, total: partial sums of pair losses, one row for each two blocks of a group.

    A group's rows are dealt by hash into blocks of about `block` rows, and a row goes to the meetings of
    its block with every other one: as many as the group has blocks. A task holds two blocks and adds up
    their pairs by sorting, so a large group is spread over all tasks and no pair is formed.
    """
    rows = df.where(both(pred, gt)).select(*by, F.col(order).alias("_i"), F.col(pred).cast("double").alias("_p"), F.col(gt).cast("double").alias("_g"))
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    null_safe = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
    dealt = rows.alias("r").join(sizes.alias("s"), null_safe).select("r.*", "_blocks", F.pmod(F.xxhash64("_i", "_p", "_g"), F.col("_blocks")).cast("int").alias("_own"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_blocks", "_other")
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "pairs long, total double"])

    def meeting(key: tuple, table: pa.Table) -> pa.Table:
        i, p, g, own = (table.column(c).to_numpy() for c in ("_i", "_p", "_g", "_own"))
        a, b = (k.as_py() for k in key[-2:])
        n, total = _pair_sum(i, p, g, own == b, a != b, margin)
        return pa.table({**{c: pa.array([k.as_py()], k.type) for c, k in zip(by, key)}, "pairs": [n], "total": [total]})

    return met.groupBy(*by, "_a", "_b").applyInArrow(meeting, schema)


def pair_loss(df: DataFrame, pred: str, gt: str, by: Sequence[str], order: str = "instrument", margin: float = 0.001, block: int = PAIR_BLOCK) -> DataFrame:
    """Mean over pairs i < j of a group of softplus(d) - d [gt_i - gt_j > margin], d = pred_i - pred_j, for groups with a pair."""
    sums = block_pairs(df, pred, gt, by, order, margin, block).groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("_t"))
    return sums.where("pairs > 0").select(*by, "pairs", (F.col("_t") / (F.col("pairs") + 1e-8)).alias("loss"))


def sequence_pair_loss(df: DataFrame, pred: str, gt: str, mask: str, by: Sequence[str], step: str, order: str = "instrument", margin: float = 0.001, block: int = PAIR_BLOCK) -> DataFrame:
    """by, pairs, loss: pair losses of sequences, over pairs of sequences at every step where both are masked in."""
    sums = block_pairs(df.where(F.col(mask) > 0), pred, gt, [*by, step], order, margin, block)
    out = sums.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("_t")).where("pairs > 0")
    return out.select(*by, "pairs", (F.col("_t") / (F.col("pairs") + 1e-8)).alias("loss"))
