"""Substring deduplication with suffix automata of reference shards.

Every window of `WINDOW` consecutive words whose word sequence also starts in a document with a
smaller doc_id is marked; every word under a marked window goes. Steps:

1. Anchors. A window's anchor is the least hash of its word 12-grams, so equal windows have equal
   anchors. An anchor that two documents hold is shared; the least document holding it owns it.
2. Shards. A reference shard is a block of `BLOCK` windows of the owner: the words of those under the anchors
   that it owns, BLOCK + WINDOW - 1 at most. Other documents send their runs under an anchor to every block of
   its owner that has it (one or two, but all blocks of a periodic text), in pieces of BLOCK windows at most, so no
   row and no automaton is larger. Shards in demand are replicated and the runs dealt among the copies.
3. Automata. Where a shard's rows arrive, sorted, its suffix automaton is built once and the runs are
   streamed through it: where the matching statistic reaches the window's length, the window stands
   in the owner and is marked. The automata are sent to the runs by this exchange rather than by a
   broadcast variable, because the reference has no size bound.
4. Rest. A window that its anchor's owner lacks can only recur in documents that also sent it in
   vain. Those few windows are settled by the least document for each 128-bit window hash. (A window that one block
   of an owner lacks and another has is settled too, to the same end.)

Edge cases: null and empty texts have no words and lose none; texts shorter than a window lose
nothing; a repeat inside one document only is no repeat; ties and repeated rows: rows that share a
doc_id, whatever their texts, are the same document and do not mark each other, but each keeps marks
of its own (they go by doc_id and the text's hash); a null doc_id is neither smaller nor larger than
any other; a very long text is cut into shards of BLOCK windows and its runs are dealt like those of
many short ones; empty tables give empty results; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.lineage import cut
from tidegrid.llm.text import body

WINDOW = 50
GRAM = 12
BLOCK = 1 << 14
#: Words that a copy of a shard should have to match.
LOAD = 20_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a * _A + np.uint64(salt)) ^ (b * _B)
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of k words, put together from runs of powers of two."""
    powers, n = [words], len(words) - k + 1
    while 2 << (len(powers) - 1) <= k:
        p, step = powers[-1], 1 << (len(powers) - 1)
        powers.append(_mix(p[:-step], p[step:], salt))
    at, out = 0, None
    for j in range(len(powers) - 1, -1, -1):
        if k >> j & 1:
            part = powers[j][at : at + n]
            out = part.copy() if out is None else _mix(out, part, salt + 1)
            at += 1 << j
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def _hashed(words: list[bytes], seed: int = 0) -> np.ndarray:
    digests = (xxhash.xxh64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh64_intdigest, words)
    return np.fromiter(digests, np.uint64, len(words))


def anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of each window, as signed longs."""
    if len(words) < window:
        return np.empty(0, np.int64)
    gram = min(GRAM, window)
    return _sliding_min(gram_hashes(_hashed(words), gram), window - gram + 1).view(np.int64)


class SuffixAutomaton:
    """Of a sequence of tokens; answers matching statistics of other sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def extend(self, tokens) -> None:
        nxt, link, length, last = self.next, self.link, self.length, self.last
        for c in tokens:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def reaches(self, tokens: list, length: int) -> list[bool]:
        """For each end position from length - 1 on: does the longest match ending there have that length."""
        nxt, link, full = self.next, self.link, self.length
        state = run = 0
        out = []
        for c in tokens:
            while state and c not in nxt[state]:
                state = link[state]
                run = full[state]
            if (to := nxt[state].get(c)) is None:
                state = run = 0
            else:
                state, run = to, run + 1
            out.append(run >= length)
        return out[length - 1 :]


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, length) of the runs of equal values that are >= 0."""
    if not len(flags):
        return
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(flags)], strict=True):
        if flags[a] >= 0:
            yield a, b - a


def anchor_blocks(all_: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[list[int] | None]]:
    """The distinct anchors of a text's windows, the first block of `block` windows that has each, and the other blocks where there are any."""
    if len(all_) <= block:
        k = np.unique(all_)
        return k, np.zeros(len(k), np.int32), [None] * len(k)
    held: dict[int, list[int]] = {}
    for no, at in enumerate(range(0, len(all_), block)):
        for k in np.unique(all_[at : at + block]).tolist():
            held.setdefault(k, []).append(no)
    return np.array(list(held), np.int64), np.array([b[0] for b in held.values()], np.int32), [b[1:] or None for b in held.values()]


def _anchored(docs: DataFrame, window: int, block: int) -> DataFrame:
    """k, doc, block, more: each anchor of each document with the blocks of windows that have it, mostly one."""
    names = ["k", "doc", "block", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            made = [*(pa.array(np.concatenate(x)) for x in (ks, ds, bs)), pa.array(more, pa.list_(pa.int32()))]
            for x in (ks, ds, bs, more):
                x.clear()
            return pa.RecordBatch.from_arrays(made, names)

        ks, ds, bs, more = [], [], [], []
        for b in batches:
            for d, t in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                k, first, others = anchor_blocks(anchors(split_words(t.as_py()), window), block)
                ks.append(k)
                ds.append(np.full(len(k), d, np.int64))
                bs.append(first)
                more += others
                if len(more) > 100_000:
                    yield flush()
            if ks:
                yield flush()

    return docs.select("doc", "text").mapInArrow(run, "k long, doc long, block int, more array<int>")


_SENT = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("copy", pa.int32()), ("kind", pa.int32()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("words", pa.binary())])


def _packed(docs: DataFrame) -> DataFrame:
    """doc, th and the text compressed, for the two exchanges that move whole texts; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [None if not t.is_valid else press.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(packed, pa.binary())], ["doc", "th", "packed"])

    return docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, packed binary")


def _unpacked(packed: pa.Scalar, press: zstandard.ZstdDecompressor) -> str | None:
    return press.decompress(packed.as_py()).decode("utf-8", "surrogatepass") if packed.is_valid else None


def owned_spans(of: np.ndarray, keys: np.ndarray, first: int, window: int) -> Iterator[tuple[int, int]]:
    """(first word, end) of the words under a block's windows with one of the keys; spans that overlap are one. of: the block's anchors, from window `first` on."""
    at = np.flatnonzero(np.isin(of, keys))
    if len(at):
        for part in np.split(at, np.flatnonzero(np.diff(at) >= window) + 1):
            yield first + int(part[0]), first + int(part[-1]) + window


def sent_runs(of: np.ndarray, k: np.ndarray, number: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first window, windows) of the runs of windows for each shard, cut at `block` windows. k: sorted anchors, one entry for each of their shards, whose numbers are in `number`."""
    low, high = np.searchsorted(k, of, "left"), np.searchsorted(k, of, "right")
    for layer in range(int((high - low).max(initial=0))):
        at = low + layer
        flags = np.where(at < high, number[np.minimum(at, len(k) - 1)], -1)
        for a, n in _runs(flags):
            for cut_ in range(a, a + n, block):
                yield int(flags[a]), cut_, min(block, a + n - cut_)


def _sent(docs: DataFrame, window: int, block: int) -> DataFrame:
    """The words that each document sends: kind 0 to its own shards, kind 1 runs of windows to those of others.

    docs: doc, th, packed, and held, an array of (k, owner, block, copies).
    """

    def owned(of: np.ndarray, keys: np.ndarray, at: int, doc: int, th: int, b: int, copies: np.ndarray, words: list[bytes]) -> Iterator[tuple]:
        for a, end in owned_spans(of, keys, at, window) if len(keys) else ():
            span = b" ".join(words[a:end])
            for copy in range(int(copies.max())):
                yield doc, b, copy, 0, doc, th, a, span

    def rows(doc: int, th: int, text: str, held: pa.Scalar) -> Iterator[tuple]:
        words = split_words(text)
        of = anchors(words, window)
        k, owner, no, copies = (np.asarray(p, dtype=np.int64) for p in held.values.flatten())
        own = owner == doc
        blocks = np.unique(no[own]).tolist()
        for at in range(0, len(of) if blocks else 0, block):
            b, here = at // block, of[at : at + block]
            mine = own & (no == b)
            yield from owned(here, k[mine], at, doc, th, b, copies[mine], words)
            # Of an anchor that another row of this doc_id has in other blocks, this row's windows go to the first of them.
            rest = np.setdiff1d(np.intersect1d(here, k[own]), k[mine])
            for f in np.unique(no[own]).tolist() if len(rest) else ():
                strays = own & (no == f) & np.isin(k, rest)
                rest = np.setdiff1d(rest, k[strays])
                yield from owned(here, k[strays], at, doc, th, f, copies[own & (no == f)], words)
        k, owner, no, copies = k[~own], owner[~own], no[~own], copies[~own]
        if not len(k):
            return
        # Entries of one shard that follow one another have one number, so that a run goes on over its anchors.
        shards, number = np.unique(np.stack([owner, no]), axis=1, return_inverse=True)
        number = number.ravel()
        most = np.ones(shards.shape[1], np.int64)
        np.maximum.at(most, number, copies)
        order = np.lexsort((number, k))
        k, number = k[order], number[order]
        for shard, a, n in sent_runs(of, k, number, block):
            o, b = (int(x) for x in shards[:, shard])
            yield o, b, hash((doc, th)) % int(most[shard]), 1, doc, th, a, b" ".join(words[a : a + n + window - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, press = [], 0, zstandard.ZstdDecompressor()
        for b in batches:
            for doc, th, packed, held in zip(b.column("doc").to_pylist(), b.column("th").to_pylist(), b.column("packed"), b.column("held"), strict=True):
                for row in rows(doc, th, _unpacked(packed, press), held):
                    out.append(row)
                    size += len(row[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in out], _SENT)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r, strict=True)) for r in out], _SENT)

    return docs.mapInArrow(run, "owner long, block long, copy int, kind int, doc long, th long, at int, words binary")


def _matched(sent: DataFrame, window: int) -> DataFrame:
    """doc, th, at, n: n marked windows from the window at on (h1 null), or one window to be settled by its hash."""
    names = ["doc", "th", "at", "n", "h1", "h2"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for owner, block, copy, kind, doc, th, at, span in zip(*(b.column(c).to_pylist() for c in _SENT.names), strict=True):
                if shard != (owner, block, copy):
                    shard, automaton = (owner, block, copy), SuffixAutomaton()
                words = span.split()
                if kind == 0:
                    automaton.extend([*words, object()])
                    continue
                hits = np.array(automaton.reaches(words, window), np.int8) - 1
                found = [(at + a, n, None, None) for a, n in _runs(hits)]
                missed = np.flatnonzero(hits < 0)
                if len(missed):
                    # Two hashes of the words themselves, so that words alike in one still differ in the other.
                    h1, h2 = (gram_hashes(_hashed(words, salt), window, salt)[missed].view(np.int64).tolist() for salt in (11, 77))
                    found += zip((at + missed).tolist(), [1] * len(missed), h1, h2, strict=True)
                for x in found:
                    for column, value in zip(out, (doc, th, *x), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    ordered = sent.repartition("owner", "block", "copy").sortWithinPartitions("owner", "block", "copy", "kind")
    return ordered.mapInArrow(run, "doc long, th long, at int, n int, h1 long, h2 long")


def marked_windows(docs: DataFrame, window: int = WINDOW, block: int | None = None) -> DataFrame:
    """doc, th, marks: arrays of (at, n), n marked windows from the word at on. docs: doc, th, text; block: windows of a shard, BLOCK where none is given."""
    block = block or BLOCK
    known = docs.where("doc IS NOT NULL AND text IS NOT NULL")
    held = _anchored(known, window, block)
    shared = (
        held.groupBy("k")
        .agg(F.min(F.struct("doc", "block", "more")).alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
        .where("first.doc < last")
        .select("k", F.col("first.doc").alias("owner"), F.explode(F.concat(F.array("first.block"), F.coalesce("first.more", F.array().cast("array<int>"))).cast("array<long>")).alias("block"), "n")
    )
    shared = cut(shared)
    demand = shared.groupBy("owner", "block").agg(F.ceil(F.sum("n") * ((window - min(GRAM, window)) // 2 + 1) / LOAD).alias("copies"))
    sharded = shared.drop("n").join(demand, ["owner", "block"])
    sending = (
        held.select("k", "doc")
        .join(sharded, "k")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("k", "owner", "block", "copies")).alias("held"))
        .join(_packed(known), "doc")
        .select("doc", "th", "packed", "held")
    )
    found = cut(_matched(_sent(sending, window, block), window))
    open_ = found.where("h1 IS NOT NULL")
    least = open_.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    settled = open_.join(least, ["h1", "h2"]).where("doc > least").select("doc", "th", "at", "n")
    return found.where("h1 IS NULL").select("doc", "th", "at", "n").union(settled).groupBy("doc", "th").agg(F.collect_set(F.struct("at", "n")).alias("marks"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) for each row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            total, gone, kept = [], [], []
            for packed, marks in zip(b.column("packed"), b.column("marks").to_pylist(), strict=True):
                words = split_words(_unpacked(packed, press))
                stays = np.ones(len(words), bool)
                for m in marks or ():
                    stays[m["at"] : m["at"] + m["n"] + window - 1] = False
                total.append(len(words))
                gone.append(int(len(words) - stays.sum()))
                kept.append(b" ".join(compress(words, stays) if gone[-1] else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = _packed(keyed).join(marked_windows(keyed, window, block), ["doc", "th"], "left").select("doc", "packed", "marks")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: words, removed words, digest of the kept words."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(body("kept"), 256).alias("kept_sha256"))
