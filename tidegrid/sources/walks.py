"""Simulated prices: geometric Brownian paths and noisy observations of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def random_walk(spark: SparkSession, s0: float = 100.0, mu: float = 0.0, sigma: float = 0.02, steps: int = 250, dt: float = 1.0, paths: int = 10, seed: int = 42) -> DataFrame:
    """path, step, price: s0 exp(cumsum((mu - sigma^2 / 2) dt + sigma sqrt(dt) z)); step 0 is s0."""
    if s0 <= 0 or sigma < 0 or steps < 1 or paths < 1 or dt <= 0:
        raise ValueError("s0 and dt must be positive, sigma not negative, steps and paths at least one")
    grid = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    # Draws come from hashes of (seed, path, step) by Box and Muller, so a lost task redraws the same path.
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "path", "step"), F.lit((1 << 31) - 1)) + 0.5) / float((1 << 31) - 1)
    z = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * F.pi() * u(2))
    step = F.when(F.col("step") == 0, 0.0).otherwise((mu - sigma * sigma / 2) * dt + sigma * dt**0.5 * z)
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("path", "step", (s0 * F.exp(F.sum(step).over(w))).alias("price"))


def noisy_walk(spark: SparkSession, noise: float = 0.01, mode: str = "lognormal", latent: bool = False, seed: int = 42, **walk) -> DataFrame:
    """The walk seen with noise: price * exp(e), or max(price + e, tiny); the true price as `latent` if asked for."""
    if mode not in ("lognormal", "additive"):
        raise ValueError("mode is lognormal or additive")
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(k), "path", "step"), F.lit((1 << 31) - 1)) + 0.5) / float((1 << 31) - 1)
    e = F.sqrt(-2 * F.ln(u(3))) * F.cos(2 * F.pi() * u(4)) * noise
    seen = F.col("price") * F.exp(e) if mode == "lognormal" else F.greatest(F.col("price") + e, F.lit(1e-12))
    out = random_walk(spark, seed=seed, **walk).withColumns({"latent": F.col("price"), "price": seen})
    return out if latent else out.drop("latent")
