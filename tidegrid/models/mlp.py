"""The feature consumer: residual networks applied to feature rows in Arrow batches, and batch losses."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cache
from math import erf, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.xsection import both, pair_loss, sequence_pair_loss

MODELS: dict = {}


def register_model(name: str):
    def put(f):
        MODELS[name] = f
        return f

    return put


def time_embedding(t: str | Column, d: int) -> Column:
    """Array of sin and cos of t exp(-i ln(500) / d) for even i under d."""
    t = F.col(t) if isinstance(t, str) else t
    return F.array(*[f(t * float(np.exp(-i * log(500.0) / d))) for i in range(0, d, 2) for f in (F.sin, F.cos)])


def _norm(x: np.ndarray, scale: np.ndarray | float = 1.0, shift: np.ndarray | float = 0.0) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * scale + shift


#: The error function at steps of 1/512, built when first asked for, between which a cubic follows value and slope.
_STEPS, _REACH = 512, 6


@cache
def _erf_table() -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(-_REACH * _STEPS, _REACH * _STEPS + 2) / _STEPS
    return np.array([erf(v) for v in x]), 2 / sqrt(pi) * np.exp(-x * x) / _STEPS


def erf_of(x: np.ndarray) -> np.ndarray:
    """The error function to twelve digits."""
    values, slopes = _erf_table()
    at = (np.clip(x, -_REACH, _REACH) + _REACH) * _STEPS
    i = at.astype(np.int64)
    t = at - i
    a, b, c, d = values[i], values[i + 1], slopes[i], slopes[i + 1]
    return ((2 * t - 3) * t * t + 1) * a + (3 - 2 * t) * t * t * b + ((t - 2) * t + 1) * t * c + (t - 1) * t * t * d


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf_of(x / sqrt(2)))


def _swish(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def _linear(x: np.ndarray, layer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return x @ layer[0] + layer[1]


def init_weights(inputs: int, outputs: int, hidden: int = 32, blocks: int = 2, gated: bool = False, seed: int = 0, post_norm: bool = False, final_norm: bool = False, input_norm: str | None = None, position: int = 0) -> dict:
    """Seeded weights of a residual network: inputs -> hidden, blocks as wide, hidden -> outputs.

    gated: SwiGLU blocks, else GELU; post_norm: blocks normalise their sum, else their input;
    input_norm: "layer" (scaled) or "batch" (running mean and variance); position: width of the time embedding that is added.
    """
    r = np.random.default_rng(seed)
    lin = lambda a, b: (r.normal(0, a**-0.5, (a, b)), np.zeros(b))
    out = {"in": lin(inputs, hidden), "blocks": _blocks(lin, hidden, blocks, gated, post_norm), "out": lin(hidden, outputs)}
    return out | _ends(lin, inputs, hidden, outputs, final_norm, input_norm, position)


def _blocks(lin, hidden: int, blocks: int, gated: bool, post_norm: bool) -> list[dict]:
    return [{"scale": np.ones(hidden), "shift": np.zeros(hidden), "up": lin(hidden, hidden), "gate": lin(hidden, hidden) if gated else None, "down": lin(hidden, hidden), "post_norm": post_norm} for _ in range(blocks)]


def _ends(lin, inputs: int, hidden: int, outputs: int, final_norm: bool, input_norm: str | None, position: int) -> dict:
    return {
        "final_norm": (np.ones(outputs), np.zeros(outputs)) if final_norm else None,
        "input_norm": {"layer": (np.ones(inputs),), "batch": (np.zeros(inputs), np.ones(inputs)), None: None}[input_norm],
        "position": lin(position, hidden) if position else None,
    }


def init_dual(inputs: int, outputs: tuple[int, int], compose: bool = False, seed: int = 0, **kw) -> dict:
    """Two networks over the same input."""
    return {"first": init_weights(inputs, outputs[0], seed=seed, **kw), "second": init_weights(inputs, outputs[1], seed=seed + 1, **kw), "compose": compose}


def init_dual_head(inputs: int, outputs: tuple[int, int], hidden: int = 32, blocks: int = 2, gated: bool = False, seed: int = 0, post_norm: bool = False, final_norm: bool = False, input_norm: str | None = None) -> dict:
    """Two towers of blocks after one projection, each with its own head."""
    r = np.random.default_rng(seed)
    lin = lambda a, b: (r.normal(0, a**-0.5, (a, b)), np.zeros(b))
    towers = [{"blocks": _blocks(lin, hidden, blocks, gated, post_norm), "out": lin(hidden, n), "final_norm": (np.ones(n), np.zeros(n)) if final_norm else None} for n in outputs]
    return {"in": lin(inputs, hidden), "towers": towers, "input_norm": _ends(lin, inputs, hidden, 1, False, input_norm, 0)["input_norm"]}


def _entered(w: Mapping, x: np.ndarray) -> np.ndarray:
    norm = w.get("input_norm")
    if norm is not None:
        x = _norm(x, norm[0]) if len(norm) == 1 else (x - norm[0]) / np.sqrt(norm[1] + 1e-5)
    return _linear(x, w["in"])


def _tower(blocks: Sequence[Mapping], h: np.ndarray) -> np.ndarray:
    for b in blocks:
        z = h if b["post_norm"] else _norm(h, b["scale"], b["shift"])
        z = _swish(_linear(z, b["gate"])) * _linear(z, b["up"]) if b["gate"] is not None else _gelu(_linear(z, b["up"]))
        h = h + _linear(z, b["down"])
        if b["post_norm"]:
            h = _norm(h, b["scale"], b["shift"])
    return h


def _left(w: Mapping, h: np.ndarray) -> np.ndarray:
    out = _linear(h, w["out"])
    return out if w.get("final_norm") is None else _norm(out, *w["final_norm"])


def embedded(t: np.ndarray, d: int) -> np.ndarray:
    """The time embedding of whole batches: sines in even places, cosines in odd ones."""
    angle = t[:, None] * np.exp(-np.arange(0, d, 2) * log(500.0) / d)
    return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(t), d)


@register_model("mlp")
def residual_mlp(w: Mapping, x: np.ndarray, position: np.ndarray | None = None) -> np.ndarray:
    h = _entered(w, x)
    if w.get("position") is not None:
        h = h + _linear(embedded(position, len(w["position"][0])), w["position"])
    return _left(w, _tower(w["blocks"], h))


@register_model("dual_mlp")
def dual_mlp(w: Mapping, x: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Both networks' outputs; composed, also the first's plus the second's leading output in shares of the day's progress.

    A composed first network has three outputs, whose shares are a ninth, a sixth and a third.
    """
    y1, y2 = (residual_mlp(w[k], x, position) for k in ("first", "second"))
    if not w["compose"]:
        return np.concatenate([y1, y2], axis=1)
    progress = position[:, None] / 240
    return np.concatenate([y1, y2, y1 + y2[:, :1] * progress * np.array([1 / 9, 1 / 6, 1 / 3])], axis=1)


@register_model("dual_head_mlp")
def dual_head_mlp(w: Mapping, x: np.ndarray, position: np.ndarray | None = None) -> np.ndarray:
    h = _entered(w, x)
    return np.concatenate([_left(t, _tower(t["blocks"], h)) for t in w["towers"]], axis=1)


def n_outputs(w: Mapping) -> int:
    if "towers" in w:
        return sum(len(t["out"][1]) for t in w["towers"])
    if "first" in w:
        a, b = (len(w[k]["out"][1]) for k in ("first", "second"))
        return a + b + (a if w["compose"] else 0)
    return len(w["out"][1])


def predict(df: DataFrame, features: str, weights: Mapping, keys: Sequence[str], model: str = "mlp", outputs: Sequence[int] | None = None, position: str | None = None) -> DataFrame:
    """keys and pred_i for each row, missing where a feature is; the weights are broadcast (their size is the model's, not the data's)."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    kinds = dict(df.dtypes)
    run_model, take = MODELS[model], list(outputs) if outputs is not None else None
    names = [f"pred_{i}" for i in (take if take is not None else range(n_outputs(weights)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(features).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                y = run_model(sent.value, x, np.asarray(b.column("_pos"), dtype=np.float64))
                y = y if take is None else y[:, take]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *(pa.array(c, from_pandas=True) for c in y.T)], [*keys, *names])

    place = F.col(position) if position else F.lit(0)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names)])
    return df.select(*keys, features, place.cast("double").alias("_pos")).mapInArrow(run, schema)


LOSSES: dict = {}


def register_loss(name: str):
    def put(f):
        LOSSES[name] = f
        return f

    return put


@register_loss("mae")
def mae(df: DataFrame, pred: str, gt: str, by: Sequence[str]) -> DataFrame:
    return df.where(both(pred, gt)).groupBy(*by).agg(F.avg(F.abs(F.col(pred) - F.col(gt))).alias("loss"))


@register_loss("mse")
def mse(df: DataFrame, pred: str, gt: str, by: Sequence[str]) -> DataFrame:
    d = F.col(pred) - F.col(gt)
    return df.where(both(pred, gt)).groupBy(*by).agg(F.avg(d * d).alias("loss"))


@register_loss("contrastive_seq")
def contrastive_sequences(df: DataFrame, pred: str, gt: str, by: Sequence[str], step: str = "slot", mask: str = "mask") -> DataFrame:
    return sequence_pair_loss(df, pred, gt, mask, by, step).select(*by, "loss")


@register_loss("contrastive")
def contrastive(df: DataFrame, pred: str, gt: str, by: Sequence[str]) -> DataFrame:
    return pair_loss(df, pred, gt, by).select(*by, "loss")


def hybrid(df: DataFrame, parts: Sequence[tuple[str, str, str, float]], by: Sequence[str]) -> DataFrame:
    """by and each part's loss beside their weighted total; parts: (loss, prediction, target, weight)."""
    out, total = None, F.lit(0.0)
    for loss, pred, gt, weight in parts:
        name = f"{loss}_{pred}_{gt}"
        one = LOSSES[loss](df, pred, gt, by).withColumnRenamed("loss", name)
        out = one if out is None else out.join(one, list(by))
        total = total + weight * F.col(name)
    return out.withColumn("total", total)
