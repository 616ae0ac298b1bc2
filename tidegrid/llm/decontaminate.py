"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and a check of what it finds.

Every training document is cut into overlapping passages of twice the longest item's words, so each
item that stands in a document lies whole in one of them. A passage is a query against the inverted
index of the items, a set of words: how often it repeats a word doesn't count. Impacts are BM25
weights over the item's own total, so the threshold is the share of an item's weight that a passage
must hold, alike for short and long items. Document frequencies, the number of items and their mean
length are counted by Spark over all items.

Retrieval is exact and leaves no word out. Postings lie in blocks of `BLOCK` items with the largest
impact of each term. An item's commonest words, as far as they carry less than `SPARE` of the
threshold together, can't bring it there alone: a first sum over the block maxima of the other,
rarer words discards most passages and blocks of items. The WAND loop runs on what is left, with all words.

What is retrieved is verified: a share of the question's 5-grams and of the answer's words in
sequence must stand in the passage. The answer is the item's last sentence, or the last third of
its words if there is just one sentence.

Items are dealt by hash to shards of about SHARD_CHARS characters, which only split the postings: a
shard's index is broadcast, used in one pass over the documents and dropped before the next, so a
benchmark of any size is served whole with bounded memory.

Edge cases: null and empty texts and items match nothing; items without words are skipped; repeated
items (id and text alike) count once, items that share only a text or only an id each for themselves;
ties: all items over the threshold are reported, in the order of their ids; a very long text is cut
into passages like any other, with memory in proportion to its words; a null doc_id is reported like
any other row; an empty benchmark leaves all documents clean, an empty table gives an empty result;
columns of other names pass through untouched unless their names begin with _dc_.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.lineage import cut

K1, B = 1.2, 0.75
BLOCK = 8
THRESHOLD = 0.5
COVER = 0.5
#: Share of the threshold that an item's commonest words may carry without being looked up at first.
SPARE = 0.4
SHARD_CHARS = 2_000_000
_TRIM = b".,;:!?|\"'()#*$%&<>"


def normal(word: bytes) -> bytes:
    return word.lower().strip(_TRIM)


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words."""
    sentences: list[list[bytes]] = [[]]
    for w in text.encode("utf-8", "surrogatepass").split():
        sentences[-1].append(w)
        if w[-1:] in b".?!":
            sentences.append([])
    parts = [p for p in ([x for x in map(normal, s) if x] for s in sentences) if p]
    if not parts:
        return [], []
    if len(parts) > 1:
        return [w for s in parts[:-1] for w in s], parts[-1]
    at = max(1, len(parts[0]) * 2 // 3)
    return parts[0][:at], parts[0][at:] or parts[0][-1:]


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Inverted lists with block maxima over a shard of items.

    rows: (item_id, question words, answer words, {word: how many of all items have it}); n, mean,
    longest: the number of all items, their mean and greatest number of words.
    """

    def __init__(self, rows: list[tuple[int, list[bytes], list[bytes], dict[bytes, int]]], n: int, mean: float, longest: int, threshold: float = THRESHOLD) -> None:
        self.ids, self.parts = [r[0] for r in rows], [(r[1], r[2]) for r in rows]
        self.longest, self.threshold = max(1, longest), threshold
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        rarer: dict[bytes, dict[int, float]] = defaultdict(dict)
        self.need = np.full(max(1, -(-len(rows) // BLOCK)), np.inf)
        for d, (_, q, a, df) in enumerate(rows):
            tf, size = Counter(q + a), len(q) + len(a)
            # The commonest words first.
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (K1 + 1) / (tf[t] + K1 * (1 - B + B * size / mean)) for t in sorted(tf, key=lambda t: (-df[t], t))}
            total, spared = sum(weight.values()), 0.0
            asked = False
            for t, x in weight.items():
                x /= total
                lists[t].append((d, x))
                asked = asked or spared + x > SPARE * threshold
                if asked:
                    rarer[t][d // BLOCK] = max(rarer[t].get(d // BLOCK, 0.0), x)
                else:
                    spared += x
            self.need[d // BLOCK] = min(self.need[d // BLOCK], threshold - spared)
        self.terms = {t: k for k, t in enumerate(sorted(lists))}
        self.postings: list[dict[int, list[tuple[int, float]]]] = []
        for t in self.terms:
            blocks: dict[int, list[tuple[int, float]]] = {}
            for d, x in lists[t]:
                blocks.setdefault(d // BLOCK, []).append((d, x))
            self.postings.append(blocks)
        self.block_max = [{b: max(x for _, x in held) for b, held in blocks.items()} for blocks in self.postings]
        # Maxima of the rarer words, in one array for all terms.
        held = [sorted(rarer[t].items()) for t in self.terms]
        self.many = np.array([len(h) for h in held], np.int64)
        self.starts = np.cumsum(self.many) - self.many
        self.blocks = np.array([b for h in held for b, _ in h], np.int64)
        self.maxima = np.array([x for h in held for _, x in h], np.float64)

    def wand(self, terms: list[int], threshold: float, among: list[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items (of the blocks `among`) that reach the threshold, by block-max WAND over distinct terms."""
        end, found = len(self.ids), []
        # Blocks whose maxima over the distinct terms fall short are left out of the lists beforehand.
        bound_of: dict[int, float] = defaultdict(float)
        for t in terms:
            for b, x in self.block_max[t].items() if among is None else [(b, self.block_max[t][b]) for b in among if b in self.block_max[t]]:
                bound_of[b] += x
        live = sorted(b for b, x in bound_of.items() if x >= threshold - 1e-6)
        if not live:
            return found
        lists = []
        for t in terms:
            here = [b for b in live if b in self.postings[t]]
            if here:
                lists.append([0, [p for b in here for p in self.postings[t][b]], max(self.block_max[t][b] for b in here), t])
        at = lambda x: x[1][x[0]][0] if x[0] < len(x[1]) else end

        def seek(x: list, item: int) -> None:
            while x[0] < len(x[1]) and x[1][x[0]][0] < item:
                x[0] += 1

        while True:
            lists = sorted((x for x in lists if at(x) < end), key=at)
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= threshold - 1e-6:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = at(lists[pivot])
            block = item // BLOCK
            last = pivot
            while last + 1 < len(lists) and at(lists[last + 1]) == item:
                last += 1
            if sum(self.block_max[x[3]].get(block, 0.0) for x in lists[: last + 1]) < threshold - 1e-6:
                # Nothing up to the end of the block, or up to the next list's item, can reach the threshold.
                to = min((block + 1) * BLOCK, at(lists[last + 1]) if last + 1 < len(lists) else end)
                for x in lists[: last + 1]:
                    seek(x, max(to, item + 1))
            elif at(lists[0]) == item:
                total = sum(x[1][x[0]][1] for x in lists[: last + 1])
                if total >= threshold - 1e-9:
                    found.append((item, total))
                for x in lists[: last + 1]:
                    x[0] += 1
            else:
                for x in lists[:pivot]:
                    seek(x, item)

    def verified(self, item: int, passage: list[bytes], cover: float) -> bool:
        for words, size in zip(self.parts[item], (5, 3), strict=True):
            wanted = grams(words, size)
            if wanted:
                size = min(size, len(words))
                held = set(zip(*(passage[i:] for i in range(size)), strict=False))
                if len(wanted & held) < cover * len(wanted):
                    return False
        return True

    def candidates(self, number: np.ndarray) -> list[tuple[int, list[int]]]:
        """Passages and the blocks that may reach the threshold in them, by sums of the rarer words' maxima.

        number: the term of each word of a text, -1 for none. Passage c is the longest item's length
        of words from c times that length on, and as many again.
        """
        chunks = max(1, -(-len(number) // self.longest))
        place = np.flatnonzero(number >= 0)
        place = place[self.many[number[place]] > 0]
        # A word counts once in a chunk of half a passage.
        once = np.unique(place // self.longest * len(self.terms) + number[place])
        chunk, term = once // len(self.terms), once % len(self.terms)
        many, width = self.many[term], len(self.need)
        total = np.cumsum(many)
        out: set[tuple[int, int]] = set()
        lo = 0
        while lo < len(term):
            # Some million maxima at a time, cut between chunks; the last chunk is taken again with the next.
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 22), side="right"))
            hi = max(hi, int(np.searchsorted(chunk, chunk[lo] + 2)))
            hi = int(np.searchsorted(chunk, chunk[hi])) if hi < len(term) else hi
            m = many[lo:hi]
            at = np.repeat(self.starts[term[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key, back = np.unique(np.repeat(chunk[lo:hi], m) * width + self.blocks[at], return_inverse=True)
            sums = np.bincount(back, self.maxima[at], len(key))
            after = np.searchsorted(key, key + width)
            follows = after < len(key)
            follows[follows] = key[after[follows]] == key[follows] + width
            both = sums.copy()
            both[follows] += sums[after[follows]]
            for passage, value, which in ((key // width, both, slice(None)), (key // width - 1, sums, slice(None))):
                worth = (value[which] >= self.need[key % width] - 1e-6) & (passage >= 0) & (passage <= max(0, chunks - 2))
                out.update(zip(passage[worth].tolist(), (key % width)[worth].tolist(), strict=True))
            lo = int(np.searchsorted(chunk, chunk[hi - 1])) if hi < len(term) and chunk[hi - 1] > chunk[lo] else hi
        found: dict[int, list[int]] = {}
        for c, b in sorted(out):
            found.setdefault(c, []).append(b)
        return list(found.items())

    def leaks(self, text: str | None, known: dict[bytes, int], cover: float) -> list[int]:
        """Ids of the items that a text holds. known: term numbers by word, filled as words are met."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        for w in set(words).difference(known):
            known[w] = self.terms.get(normal(w), -1)
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        found: set[int] = set()
        for c, blocks in self.candidates(number):
            span = slice(c * self.longest, (c + 2) * self.longest)
            terms = np.unique(number[span])
            hits = self.wand(terms[terms >= 0].tolist(), self.threshold, blocks)
            if hits:
                passage = [x for x in map(normal, words[span]) if x]
                found.update(item for item, _ in hits if item not in found and self.verified(item, passage, cover))
        return sorted({self.ids[i] for i in found}, key=lambda i: (i is not None, i or 0))


def prepared(items: DataFrame) -> tuple[DataFrame, int, float, int, int]:
    """The items' words with their frequencies over all items; number, mean and greatest length of items; number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.binary())
        for b in batches:
            split = [split_item(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("th"), b.column("chars"), pa.array([q for q, _ in split], kind), pa.array([a for _, a in split], kind)], ["item_id", "th", "chars", "q", "a"])

    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    split = known.select("item_id", F.xxhash64("text").alias("th"), F.length("text").cast("bigint").alias("chars"), "text").mapInArrow(run, "item_id long, th long, chars long, q array<binary>, a array<binary>")
    split = cut(split.where(F.size("q") + F.size("a") > 0).withColumn("row", F.concat_ws(":", "item_id", "th")))
    n, words, longest, chars = split.agg(F.count("*"), F.sum(F.size("q") + F.size("a")), F.max(F.size("q") + F.size("a")), F.sum("chars")).first()
    held = split.select("row", F.explode(F.array_distinct(F.concat("q", "a"))).alias("t"))
    df = held.groupBy("t").agg(F.count("*").alias("n"))
    of = held.join(df, "t").groupBy("row").agg(F.collect_list(F.struct("t", "n")).alias("df"))
    shards = max(1, -(-(chars or 0) // SHARD_CHARS))
    full = split.join(of, "row").select("item_id", "th", "q", "a", "df", F.pmod(F.xxhash64("item_id", "th"), F.lit(shards)).alias("shard"))
    return (cut(full) if shards > 1 else full), n, (words or 0) / max(1, n), longest or 1, shards


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, cover: float = COVER) -> DataFrame:
    """docs with _dc_items, the sorted ids of the items that each text holds; all columns stay."""
    spark = docs.sparkSession
    table, n, mean, longest, shards = prepared(items)

    def index(shard: int):
        rows = table.where(F.col("shard") == shard).orderBy(F.col("item_id").asc_nulls_first(), "th").collect()
        return spark.sparkContext.broadcast(Index([(r.item_id, [bytes(x) for x in r.q], [bytes(x) for x in r.a], {bytes(x.t): x.n for x in r.df}) for r in rows], n, mean, longest, threshold))

    def searched(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[bytes, int] = {}
            for b in batches:
                if len(known) > 150_000:
                    known.clear()
                found = [held.value.leaks(t.as_py(), known, cover) for t in b.column("_dc_text")]
                kept = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names[:-1], "_dc_items"])

        before = docs.withColumn("_dc_text", F.col("text").cast("string"))
        schema = docs.schema.jsonValue()
        schema["fields"].append({"name": "_dc_items", "type": {"type": "array", "elementType": "long", "containsNull": True}, "nullable": True, "metadata": {}})
        return before.mapInArrow(run, type(docs.schema).fromJson(schema))

    none = F.array().cast("array<bigint>")
    if not n:
        return docs.withColumn("_dc_items", none)
    if shards == 1:
        return searched(index(0))
    each = []
    for shard in range(shards):
        held = index(shard)
        each.append(cut(searched(held).select("doc_id", F.xxhash64("text").alias("th"), F.explode("_dc_items").alias("i"))))
        held.unpersist()
    united = reduce(DataFrame.union, each).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("_dc_items"))
    keyed = docs.withColumn("_dc_th", F.xxhash64("text"))
    united = united.select(F.col("doc_id").alias("_dc_id"), F.col("th").alias("_dc_th2"), "_dc_items")
    joined = keyed.join(united, F.col("doc_id").eqNullSafe(F.col("_dc_id")) & (F.col("_dc_th") == F.col("_dc_th2")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("_dc_items", none).alias("_dc_items"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    return find_leaks(docs, items).where(F.size("_dc_items") == 0).drop("_dc_items")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: whether and which items it holds."""
    out = find_leaks(docs.select("doc_id", "text"), items)
    return out.select("doc_id", (F.size("_dc_items") > 0).alias("contaminated"), F.col("_dc_items").alias("item_ids"))
