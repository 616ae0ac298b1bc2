"""Document quality from random-indexing word vectors and a small neural network.

Word vectors: each word is two terms, its hashed lower-cased form and its hashed shape (letters,
digits and signs as classes, runs shortened). A term's vector is the sum of sparse ternary index
vectors of the terms beside it, over the whole corpus: tasks count neighbouring term pairs, project
the counts on the index vectors and the projections are summed by Spark in blocks of terms. The
table of vectors has TERMS x DIM numbers at any corpus size, so it may be broadcast.

A document is the mean of its words' vectors beside the mean product of neighbouring words' vectors.
A network of two layers in numpy, fitted on a bounded sample of labelled documents, gives a logit;
a temperature fitted on sample documents that training left out turns it into a probability.

Edge cases: null and empty texts have the zero vector and get its score; one word has no neighbours;
missing labels are not learnt from and a single class gives its share as score; ties and repeated
rows are scored alike; a very long text is one row, pooled in memory in proportion to it; a null
doc_id is not held out; empty tables give empty results; columns but doc_id and text (doc_id and the
label of labels) are not read, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm import labelled

FORMS, SHAPES = 2048, 1024
TERMS, DIM, NONZERO = FORMS + SHAPES, 32, 4
HIDDEN = 24
THRESHOLD = 0.3
BLOCK = 256  # terms in a row of the exchange

_CLASS = bytes(
    ord("a") if 97 <= c <= 122 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("u") if c >= 128 else c for c in range(256)
)


def shape(word: bytes) -> bytes:
    """Classes of the bytes with runs shortened to at most two."""
    kinds = word.translate(_CLASS)
    out = bytearray()
    for c in kinds[:64]:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out)


def terms(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word.lower()) % FORMS, FORMS + zlib.crc32(shape(word)) % SHAPES


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each term."""
    rng = np.random.default_rng(7)
    out = np.zeros((TERMS, DIM), np.float64)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class Vocabulary:
    """Term ids of words, each distinct word worked out once a task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        """(words, 2) term ids."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            a, b = terms(w)
            known[w] = a << 16 | b
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.stack([both >> 16, both & 0xFFFF], axis=1)


def projected(pairs: np.ndarray) -> np.ndarray:
    """(TERMS, DIM) sums of index vectors; counts are whole numbers, exact at any size, and turned into floats block by block."""
    index = index_vectors()
    return np.concatenate([part @ index for part in pairs.reshape(-1, BLOCK, TERMS)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(TERMS, DIM) vectors of unit length from the neighbours in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = Vocabulary(), np.zeros(TERMS * TERMS, np.int64)
        for b in batches:
            held: list[np.ndarray] = []
            size = 0
            for i, text in enumerate(b.column("text")):
                ids = vocabulary.ids(text.as_py())
                for x in (0, 1):
                    for y in (0, 1):
                        held += [ids[:-1, x] * TERMS + ids[1:, y], ids[1:, y] * TERMS + ids[:-1, x]]
                size += 8 * len(ids)
                if size > 1 << 20 or i == b.num_rows - 1:
                    np.add.at(pairs, np.concatenate(held), 1)
                    held, size = [], 0
        blocks = projected(pairs).reshape(-1, BLOCK * DIM)
        live = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(list(blocks[live]), pa.list_(pa.float64()))], ["block", "v"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "block long, v array<double>")
    each = parts.select("block", F.posexplode("v").alias("i", "x")).where("x <> 0").groupBy("block", "i").agg(F.sum("x").alias("x"))
    got = each.select((F.col("block") * (BLOCK * DIM) + F.col("i")).alias("at"), "x").toPandas()
    out = np.zeros(TERMS * DIM)
    out[got["at"].to_numpy(np.int64)] = np.round(got["x"].to_numpy(), 3)
    out = out.reshape(TERMS, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of both kinds of terms, and the mean product of neighbours' form vectors."""
    if not len(ids):
        return np.zeros(3 * DIM)
    forms, shapes = vectors[ids[:, 0]], vectors[ids[:, 1]]
    next_ = (forms[:-1] * forms[1:]).mean(0) if len(ids) > 1 else np.zeros(DIM)
    return np.concatenate([forms.mean(0), shapes.mean(0), next_])


class Network:
    """Two layers with a tanh between; standardised input; logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.01, decay: float = 1e-3) -> None:
        rng = np.random.default_rng(11)
        self.temperature = 1.0
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
        if len(np.unique(y)) < 2:
            return
        self.p[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
        z, m, v = (x - self.mean) / self.scale, [0.0] * 4, [0.0] * 4
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 512):
                take, step = order[at : at + 512], step + 1
                hidden = np.tanh(z[take] @ self.p[0] + self.p[1])
                out = 1 / (1 + np.exp(-np.clip(hidden @ self.p[2] + self.p[3], -30, 30)))
                d = (out - y[take]) / len(take)
                dh = d[:, None] * self.p[2] * (1 - hidden**2)
                for i, g in enumerate((z[take].T @ dh + decay * self.p[0], dh.sum(0), hidden.T @ d + decay * self.p[2], d.sum())):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on a grid."""
        if not len(y):
            return
        out = self.logits(x)
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -out, out) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def arrays(self) -> tuple:
        return self.mean, self.scale, *self.p, self.temperature


def _probability(net: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, a, b, c, d, temperature = net
    return 1 / (1 + np.exp(-np.clip((np.tanh((x - mean) / scale @ a + b) @ c + d) / temperature, -30, 30)))


def _pooled_rows(docs: DataFrame, vectors, keep: list[str], net: tuple | None = None) -> DataFrame:
    """The kept columns and x, the pooled vector, or with a network p, the probability."""
    kinds = dict(docs.dtypes)
    out = "x array<double>" if net is None else "p double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for b in batches:
            x = np.array([pooled(vocabulary.ids(t.as_py()), vectors.value) for t in b.column("text")]).reshape(-1, 3 * DIM)
            value = pa.array(list(x), pa.list_(pa.float64())) if net is None else pa.array(_probability(net, x))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), value], [*keep, out.split()[0]])

    return docs.select("text", *keep).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), out]))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = labelled.PER_CLASS) -> DataFrame:
    """doc_id, held_out, score for every row of docs."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    fit = _pooled_rows(labelled.sample(docs, labels, label, per_class), vectors, ["doc_id", "y", "part"]).toPandas().sort_values("doc_id")
    x, y, part = np.array(fit["x"].tolist()).reshape(-1, 3 * DIM), fit["y"].to_numpy(np.float64), fit["part"].to_numpy()
    net = Network(x[part > 1], y[part > 1])
    net.calibrate(x[part <= 1], y[part <= 1])
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(labelled.fold() == 0, F.lit(False)).alias("held_out"))
    return _pooled_rows(keyed, vectors, ["doc_id", "held_out"], net.arrays()).withColumnRenamed("p", "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
