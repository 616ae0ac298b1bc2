"""Toxicity from class-conditional Kneser-Ney models.

Both classes have an interpolated Kneser-Ney model of byte n-grams inside words. The highest order
is counted for each class, over all labelled documents (none of fold 0 and none that the calibration uses).
All lower orders are continuation counts over the whole corpus, so an expression too rare to tell the classes
apart backs off to shared counts and its log-likelihood ratio goes to zero. No document and no count is left out.

The corpus is read once. A task lays its texts out in chunks: the distinct words of some megabytes of text, and
each text's words as numbers of those, with how often it has them. From then on only packed columns are exchanged: a
row holds all that one chunk or bucket has for another, sorted, as differences, compressed. Labels meet their documents in the chunks, so
no text is exchanged for them. Words go to buckets by their hash, their n-grams to buckets by their last three bytes, so that a bucket has the
shorter n-grams they end in, then by context and back, so that each meets its context's counts and its endings' probabilities.
Shared probabilities matter for n-grams that a class has counted; any other n-gram has the shared
probability in both likelihoods, times the weight that its context leaves to it, so its ratio is one number for
its context (zero where neither class has the context). N-grams' ratios go back to the buckets of words, words' ratios to
the chunks that have them, in the order of what was asked: nothing that grows with the corpus is broadcast or gathered. There are as
many buckets as Spark has partitions for exchanges; a task holds one of them.

A document's evidence is length-normalised: the mean log-likelihood ratio a word, and the means over
its most toxic words, as a few toxic words in a long text hardly move the mean over all. A logistic
calibration, fitted on all labelled documents that the counts left out (parts below KEPT_BACK of ten), turns evidence into
a probability; its Newton steps are aggregates over the table of evidence.

Edge cases: null and empty texts have no evidence and get the score of the intercept; a missing
label is not learnt from; a document with both labels counts for both; with only one class the score is that class's share;
ties and repeated rows are scored alike; a very long text is one row of one chunk; a null doc_id is not held out; empty tables
give empty results; columns but doc_id and text (doc_id and the label of labels) are not read, whatever they are called.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import labelled
from tidegrid.llm.lineage import cut

ORDER = 7
#: The order up to which shared probabilities go to every task: pairs of bytes.
LOW = 2
DISCOUNT = 0.75
#: Bytes of words, and documents, that close a chunk of texts.
CHUNK, CHUNK_ROWS = 48 << 20, 100_000
#: Distinct words that are taken apart together.
TOGETHER = 100_000
#: What is exchanged: whom a row goes to, whom it comes from, its documents, its packed columns.
_SENT = pa.schema({"to": pa.int64(), "of": pa.int64(), "docs": pa.list_(pa.int64()), "packed": pa.binary()})
_SENT_DDL = "to long, of long, docs array<long>, packed binary"
#: Labelled documents of each class, and bytes of their texts, in a bounded choice, at most.
COUNTED, COUNTED_BYTES = 20_000, 8 << 20
#: Of ten parts of the labelled documents, those kept back for the calibration.
KEPT_BACK = 3
#: Of so many words with the highest ratios the mean is evidence.
TOPS = (1, 3, 8)
#: Word ratios (natural logarithms) over which a word counts as toxic; the share of such words is evidence.
OVER = (1.0, 2.0)
WIDTH = 2 + len(TOPS) + 2 * len(OVER)
_TRIM = b".,;:!?|\"'()#*$%&"


def normal(word: bytes) -> bytes:
    return word.lower().strip(_TRIM)


def gram_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words (each within spaces) packed in longs, and where each word's begin."""
    pad = b" " * (ORDER - 1)
    joined = b"".join(pad + w + b" " for w in words)
    a = np.frombuffer(joined, np.uint8).astype(np.int64)
    if len(a) < ORDER:
        return np.empty(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(a) - ORDER + 1, np.int64)
    for i in range(ORDER):
        key = key << 8 | a[i : len(a) - ORDER + 1 + i]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
    take = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return key[take], np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Held(dict):
    """Numbers of words: raw words that are alike once normalised have one number; `words` lists them."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.words.setdefault(normal(word), len(self.words))
        return n


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte by byte of all values, compressed."""
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return struct.pack("<B", len(columns)) + b"".join(struct.pack("<I2s", len(c), c.dtype.str[1:].encode()) for c in columns) + pa.Codec("zstd", compression_level=9).compress(body, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    head = [struct.unpack_from("<I2s", packed, 1 + 6 * i) for i in range(packed[0])]
    shapes = [(n, np.dtype(kind.decode())) for n, kind in head]
    body = np.frombuffer(pa.decompress(packed[1 + 6 * len(head) :], sum(n * kind.itemsize for n, kind in shapes), "zstd"), np.uint8)
    out, at = [], 0
    for n, kind in shapes:
        out.append(body[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _pack_values(x: np.ndarray) -> bytes:
    """Ratios, of which many may be equal, in single precision."""
    x = x.astype(np.float32)
    values, at = np.unique(x, return_inverse=True)
    return _pack(values, at.astype(np.uint32)) if 2 * len(values) < len(x) else _pack(x)


def _values(packed: bytes) -> np.ndarray:
    x, *at = _unpack(packed)
    return (x[at[0]] if at else x).astype(np.float64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences (modulo the type's range), of which cumulated sums are x."""
    return np.diff(x, prepend=x.dtype.type(0))


def _sent(rows: list[tuple[int, int, list | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_SENT.types)], schema=_SENT)


def _dealt(bucket: np.ndarray, of: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its part of the columns, in their order; the first one holds keys in ascending order."""
    order, edges = _by_bucket(bucket)
    rows = []
    for first, end in zip(edges, edges[1:]):
        keys, *rest = (c[order[first:end]] for c in columns)
        rows.append((int(bucket[order[first]]), of, None, _pack(_steps(keys), *rest)))
    return _sent(rows)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order by bucket, and where each one's part begins in it."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    return order, [0, *edges.tolist(), len(bucket)] if len(bucket) else [0]


def _met(df: DataFrame, of: Callable[[int, list[dict]], pa.RecordBatch], schema: str = _SENT_DDL) -> DataFrame:
    """of(to, rows) over all rows that go to one place, by whom they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("to", "of", "docs", "packed")}
                if held and row["to"] != held[0]["to"]:
                    yield of(held[0]["to"], held)
                    held = []
                held.append(row)
        if held:
            yield of(held[0]["to"], held)

    return df.repartition("to").sortWithinPartitions("to", "of").mapInArrow(run, schema)


def _buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucket(word: bytes, buckets: int) -> int:
    """By its beginning, so that words of a bucket share n-grams; long words, of which many may begin alike, by all of it."""
    return zlib.crc32(word[:4] if len(word) < 12 else word) % buckets


def _chunks(texts: DataFrame) -> DataFrame:
    """All texts (doc_id, text), a chunk as one row to itself, from -1 (its documents, how many words they have, these as numbers, how
    often they have them, the distinct words of each bucket), and one to each bucket, from the chunk (its distinct words, sorted)."""
    buckets = _buckets(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held, ids, parts, size = Held(), [], [], 0

        def flush() -> pa.RecordBatch:
            chunk, words = task << 32 | made, sorted(held.words)
            of = np.array([_bucket(w, buckets) for w in words], np.int64)
            order, edges = _by_bucket(of)
            number = np.empty(len(words), np.int64)
            number[np.fromiter(map(held.words.__getitem__, words), np.int64, len(words))[order]] = np.arange(len(words))
            doc = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            keys, times = np.unique(doc << 32 | number[np.concatenate(parts)], return_counts=True)
            sizes = np.bincount(keys >> 32, minlength=len(parts)).astype(np.uint32)
            rows = [(chunk, -1, ids, _pack(sizes, _steps((keys & 0xFFFFFFFF).astype(np.uint32)), times.astype(np.uint32), np.bincount(of, minlength=buckets).astype(np.uint32)))]
            for first, end in zip(edges, edges[1:]):
                some = b"\n".join(words[i] for i in order[first:end].tolist())
                rows.append((int(of[order[first]]), chunk, None, _pack(np.frombuffer(some, np.uint8))))
            return _sent(rows)

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = _split(t.as_py())
                ids.append(i)
                parts.append(np.fromiter(map(held.__getitem__, words), np.uint32, len(words)))
                size += sum(map(len, words))
                if size > CHUNK or len(ids) >= CHUNK_ROWS:
                    yield flush()
                    held, ids, parts, size, made = Held(), [], [], 0, made + 1
        if ids:
            yield flush()

    return texts.select("doc_id", "text").mapInArrow(run, _SENT_DDL)


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's row to itself: sizes, numbers, times, words of each bucket."""
    sizes, steps, times, bounds = _unpack(row["packed"])
    return sizes.astype(np.int64), np.cumsum(steps, dtype=np.uint32).astype(np.int64), times.astype(np.int64), bounds.astype(np.int64)


def _classed(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """How often documents of each class (doc_id, y0, y1) have the words of a chunk: a row to each bucket, from -1 - chunk. Labels go to the chunks that have the documents."""
    texts = chunks.where("of = -1")
    owners = texts.select(F.col("to"), F.explode("docs").alias("doc_id")).distinct().join(labels, "doc_id")
    told = owners.groupBy("to").agg(F.collect_list(F.struct("doc_id", "y0", "y1")).alias("told")).select(
        "to", F.lit(0).cast("long").alias("of"), F.flatten(F.array("told.doc_id", F.col("told.y0").cast("array<long>"), F.col("told.y1").cast("array<long>"))).alias("docs"), F.lit(None).cast("binary").alias("packed")
    )

    def of(chunk: int, rows: list[dict]) -> pa.RecordBatch:
        if len(rows) < 2:
            return _sent([])
        ids, *ys = np.array(rows[1]["docs"], np.int64).reshape(3, -1).tolist()
        sizes, numbers, times, bounds = _texts(rows[0])
        edges, sums = np.cumsum([0, *bounds]), []
        for y in ys:
            known = dict(zip(ids, y, strict=True))
            mine = np.array([known.get(d, 0) for d in rows[0]["docs"]], np.int64)
            sums.append(np.bincount(numbers, times * np.repeat(mine, sizes), int(edges[-1])).astype(np.int64))
        return _sent([(g, -1 - chunk, None, _pack(*(n[edges[g] : edges[g + 1]] for n in sums))) for g in np.flatnonzero(bounds).tolist()])

    return _met(texts.unionByName(told), of)


def _merged(rows: list[dict]) -> tuple[list[bytes], np.ndarray, list[int], list[int]]:
    """Of the chunks' rows to a bucket of words: the distinct words, for each chunk's words their numbers, the chunks, and where each one's begin."""
    each = [_unpack(r["packed"])[0].tobytes().split(b"\n") for r in rows]
    found = pa.array([w for ws in each for w in ws], pa.binary()).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), [r["of"] for r in rows], np.cumsum([0, *map(len, each)]).tolist()


def _distinct_grams(words: list[bytes]) -> np.ndarray:
    parts = [np.unique(gram_keys(words[i : i + TOGETHER])[0]) for i in range(0, len(words), TOGETHER)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def _ending(k: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a packed n-gram by its last bytes: it has the n-grams of all orders over LOW that are each other's endings."""
    return ((k & (1 << 8 * (LOW + 1)) - 1) * 2654435761 >> 12) % buckets


def _grams(words: DataFrame, classed: DataFrame) -> DataFrame:
    """The n-grams of all words, and how often documents of each class have them: a row from each bucket of words to each bucket by ending."""
    buckets = _buckets(words)

    def of(g: int, rows: list[dict]) -> pa.RecordBatch:
        mine = [r for r in rows if r["of"] >= 0]
        words, at, chunks, edges = _merged(mine)
        counts = {-1 - r["of"]: _unpack(r["packed"]) for r in rows if r["of"] < 0}
        n = [np.zeros(len(words), np.int64) for _ in range(2)]
        for c, first, end in zip(chunks, edges, edges[1:], strict=False):
            for total, x in zip(n, counts.get(c, ()), strict=False):
                total[at[first:end]] += x  # a chunk has each word once
        keys = _distinct_grams(words)
        sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
        learnt = np.flatnonzero(n[0] + n[1])
        for i in range(0, len(learnt), TOGETHER):
            some = learnt[i : i + TOGETHER]
            grams, starts = gram_keys([words[j] for j in some.tolist()])
            where, times = np.searchsorted(keys, grams), np.diff(np.append(starts, len(grams)))
            for total, x in zip(sums, n, strict=True):
                total += np.bincount(where, np.repeat(x[some], times), len(keys)).astype(np.int64)
        return _dealt(_ending(keys, buckets), g, keys, *sums)

    return _met(words.unionByName(classed), of)


def _count(texts: DataFrame) -> DataFrame:
    """The n-grams of texts that carry their class (y; null for neither)."""
    numbered = texts.withColumn("doc_id", F.monotonically_increasing_id())
    chunks = cut(_chunks(numbered))
    return _grams(chunks.where("of >= 0"), _classed(chunks, numbered.select("doc_id", *[F.coalesce((F.col("y") == y).cast("int"), F.lit(0)).alias(f"y{y}") for y in (0, 1)])))


def _levelled(rows: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams that go to a bucket by ending: n, k, a, b, the bucket of the context. For the highest order (n) each n-gram and its
    counts by class, for orders down to 3 each n-gram and the n-grams of the order above that end in it."""
    each = [_unpack(r["packed"]) for r in rows]
    keys, back = np.unique(np.concatenate([np.cumsum(x[0]) for x in each]), return_inverse=True)
    out = [(ORDER, keys, *(np.bincount(back, np.concatenate([x[y] for x in each]), len(keys)).astype(np.int64) for y in (1, 2)))]
    for n in range(ORDER - 1, LOW, -1):
        keys, many = np.unique(keys & (1 << 8 * n) - 1, return_counts=True)
        out.append((n, keys, many, np.zeros(len(keys), np.int64)))
    n = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.uint8)
    k, a, b = (np.concatenate([o[i] for o in out]).astype(np.int64) for i in (1, 2, 3))
    return n, k, a, b, (((k >> 8) ^ k >> 29) * 2654435761 + n.astype(np.int64) * 40503 >> 12) % buckets


def _levels(grams: DataFrame) -> DataFrame:
    """The n-grams of all orders with their counts, from the buckets by ending to those by context."""
    buckets = _buckets(grams)

    def of(e: int, rows: list[dict]) -> pa.RecordBatch:
        n, k, a, b, context = _levelled(rows, buckets)
        return _dealt(context, e, k, n, a, b)

    return _met(grams, of)


def _contexts(levels: DataFrame) -> DataFrame:
    """The sums and numbers of n-grams by class of each n-gram's context (a context has 256 n-grams at most), back to the buckets by ending, from -1 - bucket."""

    def of(c: int, rows: list[dict]) -> pa.RecordBatch:
        each = [_unpack(r["packed"]) for r in rows]
        k, (order, a, b) = np.concatenate([np.cumsum(x[0]) for x in each]), (np.concatenate([x[i] for x in each]) for i in (1, 2, 3))
        _, back = np.unique(order.astype(np.int64) << 50 | k >> 8, return_inverse=True)
        sums = [f[back] for x in (a, b) for f in (np.bincount(back, x).astype(np.int64), np.bincount(back, x > 0).astype(np.int64))]
        edges = np.cumsum([0, *(len(x[0]) for x in each)]).tolist()
        return _sent([(r["of"], -1 - c, None, _pack(*(x[first:end] for x in sums))) for r, first, end in zip(rows, edges, edges[1:], strict=False)])

    return _met(levels, of)


def _low(grams: DataFrame) -> np.ndarray:
    """The shared probability of each pair of bytes; there are 65 536 at most. A task tells which endings of three bytes it has, in 8 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 8 * (LOW + 1), bool)
        for b in batches:
            for packed in b.column("packed"):
                seen[np.cumsum(_unpack(packed.as_py())[0]) & len(seen) - 1] = True
        k = np.flatnonzero(seen)
        yield _dealt(k & 7, TaskContext.get().partitionId(), k)

    def of(_: int, rows: list[dict]) -> pa.RecordBatch:
        k = np.unique(np.concatenate([np.cumsum(_unpack(r["packed"])[0]) for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(k & 0xFFFF, return_counts=True)], ["k", "n"])

    # An ending's pair is its last two bytes: one place has all endings of a pair.
    ends = _met(grams.mapInArrow(run, _SENT_DDL), of, "k long, n long").collect()
    n2 = np.zeros((256, 256))
    for row in ends:
        n2[row["k"] >> 8, row["k"] & 255] = row["n"]
    n1 = (n2 > 0).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p1 = (n1 - DISCOUNT + DISCOUNT * (n1 > 0).sum() / 256) / n1.sum()
        return ((n2 - DISCOUNT + DISCOUNT * (n2 > 0).sum(axis=1)[:, None] * p1) / n2.sum(axis=1)[:, None]).ravel()


def _rated(rows: list[dict], low: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams of a bucket by ending and what the buckets by context say of them: k, log P(k | toxic) - log P(k | ordinary) of every
    n-gram, whether a class has counted it, and that of n-grams after the same context that no class has."""
    n, k, a, b, context = _levelled([r for r in rows if r["of"] >= 0], buckets)
    x = {"k": k, "n": n, "a": a, "b": b} | {f"{f}_{y}": np.empty(len(k), np.int64) for y in ("a", "b") for f in ("all", "kinds")}
    said = {-1 - r["of"]: _unpack(r["packed"]) for r in rows if r["of"] < 0}
    order, edges = _by_bucket(context)
    for first, end in zip(edges, edges[1:]):
        for c, sums in zip(("all_a", "kinds_a", "all_b", "kinds_b"), said[int(context[order[first]])], strict=True):
            x[c][order[first:end]] = sums
    keys, p = np.arange(1 << 8 * LOW), low
    for n in range(LOW + 1, ORDER + 1):
        at = np.flatnonzero(x["n"] == n)
        at = at[np.argsort(x["k"][at])]
        k = x["k"][at]
        below = p[np.searchsorted(keys, k & (1 << 8 * (n - 1)) - 1)]
        of = {c: x[c][at] for c in x}
        if n < ORDER:
            keys, p = k, (of["a"] - DISCOUNT + DISCOUNT * of["kinds_a"] * below) / of["all_a"]
    with np.errstate(divide="ignore", invalid="ignore"):
        used = [np.where(of[y] > 0, (of[y] - DISCOUNT) / of[f"all_{y}"], 0.0) for y in ("a", "b")]
        left = [np.where(of[f"all_{y}"] > 0, DISCOUNT * of[f"kinds_{y}"] / of[f"all_{y}"], 1.0) for y in ("a", "b")]
    other, counted = np.log(left[1]) - np.log(left[0]), of["a"] + of["b"] > 0
    return k, np.where(counted, np.log(used[1] + left[1] * below) - np.log(used[0] + left[0] * below), other), counted, other


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """k, r: log P(k | toxic) - log P(k | ordinary) of every n-gram that a class has counted; c, r: that of any other n-gram after the context c."""
    low, buckets = _low(grams), _buckets(grams)

    def of(e: int, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _rated(rows, low, buckets)], ["k", "r", "counted", "other"])

    rated = _met(_contexts(_levels(grams)).unionByName(grams), of, "k long, r double, counted boolean, other double")
    return rated.where("counted").select("k", "r"), rated.select(F.shiftrightunsigned("k", 8).alias("c"), F.col("other").alias("r")).distinct()


Ratios = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def gathered(model: tuple[DataFrame, DataFrame]) -> Ratios:
    """Counted n-grams with their ratios, and contexts with theirs, in order: the model of a corpus that fits in memory."""
    out = []
    for table, key in zip(model, ("k", "c"), strict=True):
        found = table.toArrow()
        k, r = found.column(key).to_numpy(), found.column("r").to_numpy()
        order = np.argsort(k)
        out += [k[order], r[order]]
    return tuple(out)


def _find(sorted_: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    hit = sorted_[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def ratios(model: Ratios, words: list[bytes]) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    if not words:
        return np.empty(0)
    grams, starts = gram_keys(words)
    keys, r, contexts, other = model
    distinct, back = np.unique(grams, return_inverse=True)
    known, hit = _find(keys, r, distinct)
    rest, _ = _find(contexts, other, distinct >> 8)
    return np.add.reduceat(np.where(hit, known, rest)[back], starts)


def evidence(found: np.ndarray, times: np.ndarray) -> list[float]:
    """Length-normalised evidence of a text's distinct words' ratios and how often it has them: means over all words and over the most toxic ones, shares of toxic words, the length's logarithm."""
    if not len(found):
        return [0.0] * WIDTH
    n = int(times.sum())
    order = np.argsort(-found)[: max(TOPS)]
    top = np.repeat(found[order], np.minimum(times[order], max(TOPS)))
    over = [int(times[found > x].sum()) for x in OVER]
    return [float((found * times).sum() / n), float(np.log(n)), *(float(top[:t].sum() / t) for t in TOPS), *(o / n for o in over), *(float(np.log1p(o)) for o in over)]


def _ratings(words: DataFrame, grams: DataFrame) -> DataFrame:
    """The ratios of words, to the chunks that have them, from the buckets of words: summed over their n-grams, whose ratios go back to the buckets that have them."""
    low, buckets = _low(grams), _buckets(words)

    def answer(e: int, rows: list[dict]) -> pa.RecordBatch:
        keys, r, *_ = _rated(rows, low, buckets)
        return _sent([(x["of"], -1 - e, None, _pack_values(r[np.searchsorted(keys, np.cumsum(_unpack(x["packed"])[0]))])) for x in rows if x["of"] >= 0])

    def of(g: int, rows: list[dict]) -> pa.RecordBatch:
        words, at, chunks, edges = _merged([x for x in rows if x["of"] >= 0])
        told = {-1 - x["of"]: _values(x["packed"]) for x in rows if x["of"] < 0}
        keys = _distinct_grams(words)
        bucket = _ending(keys, buckets)
        order, parts = _by_bucket(bucket)
        r = np.empty(len(keys))
        for first, end in zip(parts, parts[1:]):
            r[order[first:end]] = told[int(bucket[order[first]])]
        ratio = []
        for i in range(0, len(words), TOGETHER):
            found, starts = gram_keys(words[i : i + TOGETHER])
            ratio.append(np.add.reduceat(r[np.searchsorted(keys, found)], starts))
        ratio = np.concatenate(ratio)[at]
        return _sent([(c, g, None, _pack_values(ratio[first:end])) for c, first, end in zip(chunks, edges, edges[1:], strict=False)])

    return _met(words.unionByName(_met(_contexts(_levels(grams)).unionByName(grams), answer)), of)


def _evidence_of(chunks: DataFrame, ratings: DataFrame) -> DataFrame:
    """doc_id and x (evidence) of every document. Ratings go to the chunks that have the word, not to every task."""

    def of(chunk: int, rows: list[dict]) -> pa.RecordBatch:
        sizes, numbers, times, _ = _texts(rows[0])
        r = np.concatenate([np.empty(0), *(_values(x["packed"]) for x in rows[1:])])[numbers]
        edges = np.cumsum([0, *sizes]).tolist()
        x = [evidence(r[first:end], times[first:end]) for first, end in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(rows[0]["docs"], pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return _met(chunks.where("of = -1").unionByName(ratings), of, "doc_id long, x array<double>")


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    mean, scale, w = weights
    return 1 / (1 + np.exp(-np.clip(((x - mean[:-1]) / scale[:-1]) @ w[:-1] + w[-1], -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WIDTH)


def _summed(fit: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(x, y), `size` numbers, over all rows of fit: a row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(_matrix(b.column("x")), b.column("y").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["task", "sums"])

    rows = fit.mapInArrow(run, "task long, sums array<double>").collect()
    return sum((np.array(r["sums"]) for r in sorted(rows, key=lambda r: r["task"])), np.zeros(size))


def _calibrate(fit: DataFrame, rounds: int = 50, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton's method over all rows of fit (x, y); rows: means, scales, weights (the last column is the intercept's).

    A round is one aggregate over the rows; what comes to the driver are sums, whose size depends on the evidence's width alone.
    """
    m = WIDTH + 1
    n, positive, *total = _summed(fit, lambda x, y: np.array([len(x), y.sum(), *x.sum(0)]), WIDTH + 2)
    share = float(np.clip(positive / n if n else 0.5, 1e-3, 1 - 1e-3))
    mean, scale = np.zeros(m), np.ones(m)
    if n:
        mean[:-1] = np.array(total) / n
        scale[:-1] = np.sqrt(_summed(fit, lambda x, y: ((x - mean[:-1]) ** 2).sum(0), WIDTH) / n) + 1e-9
    w = np.append(np.zeros(WIDTH), np.log(share / (1 - share)))
    if 0 < positive < n:
        pull = np.append(np.full(WIDTH, ridge * n), 0) / 10

        def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.hstack([(x - mean[:-1]) / scale[:-1], np.ones((len(x), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.concatenate([((z * (p * (1 - p) + 1e-6)[:, None]).T @ z).ravel(), z.T @ (p - y)])

        for _ in range(rounds):
            sums = _summed(fit, slopes, m * m + m)
            step = np.linalg.solve(sums[: m * m].reshape(m, m) + np.diag(pull + 1e-9), sums[m * m :] + pull * w)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
    return np.stack([mean, scale, w])


def _counting(texts: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of a bounded choice of documents, in the order of their ids' hashes, as many as fit COUNTED and COUNTED_BYTES: for trials, `score` counts all."""
    some = F.broadcast(labelled.chosen(labels, label, COUNTED, KEPT_BACK))
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(some, "doc_id")
    each = sizes.groupBy("doc_id", "y").agg(F.sum("size").alias("size"), F.xxhash64(F.first("doc_id"), F.lit("sample")).alias("h")).collect()  # 2 COUNTED rows at most
    taken, upto = [], [0, 0]
    for r in sorted(each, key=lambda r: (r["h"], r["doc_id"])):
        upto[r["y"]] += r["size"]
        if upto[r["y"]] <= COUNTED_BYTES:
            taken.append((r["doc_id"], r["y"]))
    return texts.sparkSession.createDataFrame(taken, "doc_id long, y int")


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Files of exchanges go once the action that wrote them has ended, as its result is checkpointed or collected; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _fitted(texts: DataFrame, learnt: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Evidence of all texts, and the calibration's weights."""
    counted = learnt.where(labelled.part() >= KEPT_BACK).groupBy("doc_id").agg(*[F.max((F.col("y") == y).cast("int")).alias(f"y{y}") for y in (0, 1)])
    chunks = cut(_chunks(texts))
    words = chunks.where("of >= 0")
    grams = cut(_grams(words, _classed(chunks, counted)))
    found = cut(_evidence_of(chunks, _ratings(words, grams)))
    return found, _calibrate(cut(found.join(learnt.where(labelled.part() < KEPT_BACK), "doc_id").select("x", "y")))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score for every row of docs."""
    with _tidy(docs.sparkSession):
        found, weights = _fitted(labelled.keyed(docs), labelled.known(labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(_probability(_matrix(b.column("x")), weights))], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(labelled.fold() == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "x").mapInArrow(run, "doc_id long, held_out boolean, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
