"""Resampling of documents by their importance for a target distribution, over bucket-partitioned inverted postings.

Features are runs of 1 to `longest` words, hashed into buckets. A bucket's gain is the logarithm of
its share in the target texts over its share in the documents; a document's weight is the sum of the
gains of its features. With Gumbel noise from a hash of the document's id, the highest scores are a
sample without replacement. Steps:

1. Postings. A task inverts its documents in blocks (of at most BLOCK_DOCS documents or BLOCK_FEATURES
   features): for each bucket, which of the block's documents hold it and how often, packed; and one
   header with the block's ids and lengths. Postings are written to the shared folder once.
2. Gains. Postings go to their bucket by an exchange and meet the counts of both corpora there, which
   were summed before it. A bucket that all documents have is as many postings as there are blocks, so
   keys are salted by block: a key has postings of about SALTED blocks at any size of the input. What a
   bucket's task emits is added up over its buckets for each block of documents first.
3. Weights. Contributions are exchanged by block and added to the block's header.
4. Draw. Documents are sorted by score over ranges (ties are split by id, then place, so that no score
   makes a task large); a document's rank is its place in its range after the sizes of the ranges before.

Edge cases: null and empty texts have no features and weight 0; they are never drawn for want of words;
a null doc_id is hashed as an empty id and sorted first; rows that repeat a doc_id are documents of
their own; ties go to the smaller doc_id, then to the earlier row of the input; without target texts, or
with empty ones, all gains follow from the documents alone; a very long text is a block of its own;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.lineage import cut

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
BLOCK_DOCS, BLOCK_FEATURES, SALTED = 8192, 2_000_000, 64

#: A-Z in lower case, other ASCII characters but digits and letters as spaces; all other bytes belong to words.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Buckets:
    """Buckets of a text's features; those of single words are remembered."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest = buckets, longest
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, n = self.known, self.buckets
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w) % n
        out = [np.fromiter(map(known.__getitem__, words), np.int32, len(words))]
        for k in range(2, self.longest + 1):
            runs = (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
            out.append(np.fromiter((zlib.crc32(r) % n for r in runs), np.int32))
        return np.concatenate(out)


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in the block (under 2^16) and counts, which take a byte each where all are small."""
    small = counts.max() < 256
    return bytes([int(small)]) + places.astype("<u2").tobytes() + counts.astype("u1" if small else "<u4").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = 3 if data[0] else 6
    n = (len(data) - 1) // width
    return np.frombuffer(data, "<u2", n, 1), np.frombuffer(data, "u1" if data[0] else "<u4", n, 1 + 2 * n)


def postings(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """bucket, block, n (features), held (packed places and counts); bucket -1 is a block's header: ids, words, features as arrays.

    docs: doc_id, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block = Buckets(buckets, longest), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        n_words: list[int] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(f) for f in found], np.int64)
            key = np.concatenate(found).astype(np.int64) << 16 | np.repeat(np.arange(len(found)), lengths)
            key, counts = np.unique(key, return_counts=True)
            bucket, place = key >> 16, key & 0xFFFF
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = [*edge[1:].tolist(), len(key)]
            held = [_packed(place[a:b], counts[a:b]) for a, b in zip(edge.tolist(), ends, strict=True)]
            n = np.add.reduceat(counts, edge) if len(key) else np.empty(0, np.int64)
            no = len(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(bucket[edge], -1), pa.int32()),
                    pa.array(np.full(no + 1, block), pa.int64()),
                    pa.array(np.append(n, 0), pa.int64()),
                    pa.array([*held, None], pa.binary()),
                    pa.array([None] * no + [ids], pa.list_(pa.int64())),
                    pa.array([None] * no + [n_words], pa.list_(pa.int64())),
                    pa.array([None] * no + [lengths.tolist()], pa.list_(pa.int64())),
                ],
                ["bucket", "block", "n", "held", "ids", "n_words", "n_features"],
            )

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = words_of(t.as_py())
                ids.append(i)
                n_words.append(len(words))
                found.append(of(words))
                size += len(found[-1])
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_FEATURES:
                    yield flush()
                    ids, n_words, found, size, block = [], [], [], 0, block + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, "bucket int, block long, n long, held binary, ids array<long>, n_words array<long>, n_features array<long>")


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """bucket, t: features of all texts. texts: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column("text"):
                total += np.bincount(of(words_of(t.as_py())), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "t"])

    return texts.mapInArrow(run, "bucket int, t long").groupBy("bucket").agg(F.sum("t").alias("t"))


def _contributions(keyed: DataFrame, buckets: int, documents: int, target: int) -> DataFrame:
    """block, places, gains: what the buckets of a task add to the weights of a block's documents. keyed: salt, bucket, block, held, s, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        salt, bucket, gain = None, None, 0

        def flush() -> pa.RecordBatch:
            places = [np.flatnonzero(w) for w in sums.values()]
            made = [
                pa.array(list(sums), pa.int64()),
                pa.array([p.astype("<u2").tobytes() for p in places], pa.binary()),
                pa.array([zlib.compress(w[p].astype("<i8").tobytes(), 1) for w, p in zip(sums.values(), places, strict=True)], pa.binary()),
            ]
            sums.clear()
            return pa.RecordBatch.from_arrays(made, ["block", "places", "gains"])

        for b in batches:
            for at, k, block, held, s, t in zip(*(b.column(c).to_pylist() for c in ("salt", "bucket", "block", "held", "s", "t")), strict=True):
                if at != salt and sums:
                    yield flush()
                if (at, k) != (salt, bucket):
                    gain = math.floor(1000 * math.log((t + 1) * (documents + buckets) / ((s + 1) * (target + buckets))))
                salt, bucket = at, k
                places, counts = _unpacked(held)
                if (w := sums.get(block)) is None:
                    w = sums[block] = np.zeros(BLOCK_DOCS, np.int64)
                w[places] += counts.astype(np.int64) * gain
        if sums:
            yield flush()

    return keyed.mapInArrow(run, "block long, places binary, gains binary")


def _weighed(parts: DataFrame) -> DataFrame:
    """doc_id, block, place, n_words, n_features, weight of every document. parts: headers and contributions, by block with the header first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, weights = None, None

        def done() -> pa.RecordBatch:
            block, ids, n_words, n_features = header
            n = len(ids)
            made = [pa.array(ids, pa.int64()), pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weights[:n])]
            return pa.RecordBatch.from_arrays(made, ["doc_id", "block", "place", "n_words", "n_features", "weight"])

        for b in batches:
            for block, ids, n_words, n_features, places, gains in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "n_words", "n_features", "places", "gains")), strict=True):
                if ids is not None:
                    if header is not None:
                        yield done()
                    header, weights = (block, ids, n_words, n_features), np.zeros(BLOCK_DOCS, np.int64)
                else:
                    weights[np.frombuffer(places, "<u2")] += np.frombuffer(zlib.decompress(gains), "<i8")
        if header is not None:
            yield done()

    return parts.mapInArrow(run, "doc_id long, block long, place int, n_words long, n_features long, weight long")


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, block, place, n_words, n_features and weight for every row of docs (doc_id, text); target: text."""
    held = cut(postings(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), buckets, longest))
    own = held.where("bucket >= 0").groupBy("bucket").agg(F.sum("n").alias("s"))
    theirs = bucket_counts(target.select(F.col("text").cast("string").alias("text")), buckets, longest)
    # At most `buckets` rows.
    both = cut(own.join(theirs, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    documents, sought = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    headers = held.where("bucket < 0")
    salts = max(1, -(-headers.count() // SALTED))
    salted = held.where("bucket >= 0").select("bucket", "block", "held", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    counts = both.where("s > 0").select("bucket", "s", "t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    keyed = salted.repartition("bucket", "salt").join(counts.repartition("bucket", "salt").hint("shuffle_hash"), ["bucket", "salt"])
    given = _contributions(keyed.sortWithinPartitions("salt", "bucket"), buckets, documents, sought)
    parts = headers.select("block", "ids", "n_words", "n_features").unionByName(given, allowMissingColumns=True)
    return _weighed(parts.repartition("block").sortWithinPartitions("block", F.col("ids").isNull()))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths from the hash of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where a document isn't drawn) for every row of docs."""
    scored = weigh(docs, target, buckets, longest).withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "able": F.col("n_words") >= least_words})
    order = [F.desc("able"), F.desc("score"), F.asc("doc_id"), F.asc("block"), F.asc("place")]
    # The sorted rows are written, as their places must not change between the two times they are read.
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    part, within = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).collect())  # a row a range
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]
    drawn = percent * sum(r["able"] for r in sizes) // 100
    starts = docs.sparkSession.createDataFrame(list(before.items()), "part long, start long")
    rank = F.col("start") + within + 1
    ranked = placed.withColumn("part", part.cast("bigint")).join(F.broadcast(starts), "part")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target)
