"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the majority vote of the XXH64 values of its word shingles. For
linking, the bits are cut into three segments of 22, 21 and 21 bits. If two fingerprints differ in
at most two bits, then some segment i agrees exactly while the next segment (cyclically) differs in
at most one bit. That segment is read as a word of the binary Golay code (23, 12): decoding it and
its 23 neighbours at one flipped bit gives up to six codeword indices, and two segments within one
bit share an index. A key is (i, exact segment i, index of the next): about 16 keys a fingerprint.

Only distinct fingerprints take part. Keys of two to `CAP` fingerprints are compared in place; every
fingerprint under a larger key goes to a finer scheme that needs no cap: with the two nibbles that
may differ blanked out (120 choices), a key holds at most 256 fingerprints. Each bucket reports not
its pairs but a star for each of its connected parts, so edges grow with members, not with pairs.

Edge cases: a null text is empty; a text without words has the fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; equal texts, repeated rows and ties share a
fingerprint and so a component, rows that share a doc_id but not a text each have their own; a null
doc_id takes part but is no component's id unless it is alone; a very long text is hashed and voted
on in steps of bounded size; empty tables give empty results; other columns are not read, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.lineage import cut

SEED = 42
CAP = 128
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b110001110101  # of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)], np.uint64)


def vote(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is set where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([vote(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _remainder(word: np.ndarray) -> np.ndarray:
    out = word.copy()
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (_GENERATOR << (bit - 11)), out)
    return out


def _errors() -> np.ndarray:
    """The error pattern of up to three bits for each of the 2048 syndromes."""
    patterns = np.array([sum(1 << i for i in c) for n in range(4) for c in combinations(range(23), n)], np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainder(patterns)] = patterns
    return out


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """Codeword indices of each 23-bit word and of its 23 neighbours, sorted along axis 1; repeats stay."""
    near = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    flat = near.ravel()
    return np.sort(((flat ^ _errors()[_remainder(flat)]) >> 11).reshape(near.shape), axis=1)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs for unsigned fingerprints."""
    cut_out = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = golay_indices(cut_out[(i + 1) % 3])
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(i) << 40) | (cut_out[i][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _blanks() -> list[int]:
    """Masks that keep all but two of the sixteen nibbles."""
    return [((1 << 64) - 1) ^ (15 << 4 * a) ^ (15 << 4 * b) for a, b in combinations(range(16), 2)]


def _keyed(fps: DataFrame, keys) -> DataFrame:
    """k (and m, a second part of the key) for each fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_of = np.asarray(b.column("fp"), dtype=np.int64).view(np.uint64)
            for at in range(0, len(all_of), 4096):
                fp = all_of[at : at + 4096]
                row, key, mark = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(fp[row].view(np.int64)), pa.array(key), pa.array(mark)], ["fp", "k", "m"])

    return fps.mapInArrow(run, "fp long, k long, m int")


def _by_code(fp: np.ndarray):
    row, key = golay_keys(fp)
    return row, key, np.zeros(len(row), np.int32)


def _by_blanks(fp: np.ndarray):
    blanks = np.array(_blanks(), np.uint64)
    masked = (fp[:, None] & blanks[None, :]).view(np.int64)
    row = np.repeat(np.arange(len(fp)), len(blanks))
    return row, masked.ravel(), np.tile(np.arange(len(blanks), dtype=np.int32), len(fp))


def star_edges(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(member, least member of its part) for the parts that links of at most `most` bits make among the members."""
    members = np.unique(members)
    bits = members.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most
    root = np.arange(len(members))
    while True:
        least = np.where(near, root[None, :], len(members)).min(axis=1)
        if (least == root).all():
            return [(int(members[i]), int(members[r])) for i, r in enumerate(root) if i != r]
        root = least[least]


def _stars(buckets: DataFrame, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [e for x in b.column("fps") for e in star_edges(np.asarray(x.values, dtype=np.int64), most)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    return buckets.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints whose components are those of all links of at most two bits."""
    if most > 2:
        raise ValueError("the segment scheme covers at most two differing bits")
    distinct = fps.select("fp").distinct()
    keyed = _keyed(distinct, _by_code)
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "k").select("fp", "k", "n"))
    small = shared.where(F.col("n") <= CAP).groupBy("k").agg(F.collect_list("fp").alias("fps")).select("fps")
    crowded = shared.where(F.col("n") > CAP).select("fp").distinct()
    fine = _keyed(crowded, _by_blanks).groupBy("k", "m").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return _stars(small, most).union(_stars(fine, most)).distinct()


def classes(docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the component) for each row of docs."""
    fps = cut(fingerprints(docs, shingle))
    roots = components(links(fps, most))
    owner = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = owner.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint in hexadecimal digits and its component."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity mode. At a similarity of 0.8 on five-word shingles, fingerprints differ in up to 18 of
# 64 bits, which no set of segment keys of bounded size covers. Fingerprints and the bands of min-wise
# sketches of the same shingle hashes give candidate pairs there; a link is a pair whose sets of
# shingles have the exact similarity. Under a key of up to HELD documents every pair is a candidate.
# Under a larger one, documents are compared with the first HELD; every document that this leaves
# outside the key's largest component is then compared with all others of the key, in blocks.

SKETCH, BANDS, ROWS = 128, 16, 4
#: More than four standard errors of a sketch: what it rules out is below the similarity asked for.
SLACK = 0.15
HELD = 32
BLOCK, CHUNK = 512, 2048  # outsiders and members of a key that meet in one task


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def sketch(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of each of SKETCH hash functions over the distinct shingles."""
    a, b = factors
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint64)
    hashes = np.unique(hashes)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(out, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp, whole (a digest of the set of shingles), sig (a byte of each minimum) and bands (hashes of groups of whole minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for b in batches:
            fps, wholes, sigs, bands = [], [], [], []
            for t in b.column("text"):
                hashes = shingle_hashes(t.as_py(), shingle)
                least = sketch(hashes, factors).astype(np.uint32)
                fps.append(vote(hashes))
                wholes.append(xxhash.xxh3_128_digest(np.unique(hashes).tobytes()))
                sigs.append((least & 0xFF).astype(np.uint8).tobytes())
                bands.append([xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(wholes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "fp", "whole", "sig", "bands"],
            )

    return _keyed_texts(docs).mapInArrow(run, "doc_id long, fp long, whole binary, sig binary, bands array<long>")


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """rep and set, the sorted distinct shingle hashes, for the rows (rep, whole) of reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["rep", "whole", "set"])

    texts = _keyed_texts(docs).join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    made = texts.mapInArrow(run, "rep long, whole binary, set binary")
    # Rows that share a doc_id may differ in text: the digest picks those of the representative.
    return made.join(reps.select("rep", "whole"), ["rep", "whole"], "left_semi").dropDuplicates(["rep", "whole"]).select("rep", "set")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    both = int((b[at] == a).sum()) if len(b) else 0
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("x", "y"))
            keep = [jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= similarity for p, q in zip(x, y, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("u"), F.col("set").alias("x")), sets.select(F.col("rep").alias("v"), F.col("set").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


class Bucket:
    """Candidate pairs of one band key as its members stream by, in memory that doesn't grow with them.

    Each member is paired with the near ones of up to HELD members before it; beyond the first HELD
    with the two nearest of these only, and the key counts as crowded.
    """

    def __init__(self, least: float) -> None:
        self.least, self.ids, self.sigs, self.crowded = least, [], np.empty((0, SKETCH), np.uint8), False

    def pairs(self, ids: list[int], sigs: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
        """Candidates among the next members and with those held, and the members found to be of a crowd."""
        room = HELD - len(self.ids)
        out, crowd, rest = [], [], len(ids)
        if room > 0:
            known, rest = len(self.ids), max(len(ids) - room, 0)
            self.ids, self.sigs = self.ids + ids[:room], np.vstack([self.sigs, sigs[:room]])
            for i in range(max(known, 1), len(self.ids)):
                near = (self.sigs[:i] == self.sigs[i]).mean(axis=1) >= self.least
                out += [(self.ids[i], self.ids[k]) for k in np.flatnonzero(near).tolist()]
        for at in range(len(ids) - rest, len(ids), 512):
            if not self.crowded:
                self.crowded, crowd = True, list(self.ids)
            crowd += ids[at : at + 512]
            near = (sigs[at : at + 512, None, :] == self.sigs[None, :, :]).mean(axis=2)
            for i, row in enumerate(near):
                best = np.argpartition(row, -2)[-2:] if len(row) > 1 else np.arange(len(row))
                out += [(ids[at + i], self.ids[k]) for k in best.tolist() if row[k] >= self.least]
        return out, crowd


def _banded_pairs(reps: DataFrame, least: float) -> DataFrame:
    """Candidates (u, v), and for members u of crowded keys a row with no v; band and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for b in batches:
            if not b.num_rows:
                continue
            band, key = (np.asarray(b.column(c)) for c in ("band", "key"))
            ids = b.column("rep").to_pylist()
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, SKETCH)
            edge = [0, *(np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(ids)]
            rows = []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if last != (band[lo], key[lo]):
                    last, bucket = (band[lo], key[lo]), None
                    if hi - lo == 1 and hi < len(ids):
                        continue  # alone under its key
                bucket = bucket or Bucket(least)
                pairs, crowd = bucket.pairs(ids[lo:hi], sigs[lo:hi])
                rows += [(u, v, None, None) for u, v in pairs] + [(u, None, int(band[lo]), int(key[lo])) for u in crowd]
            u, v, bands, keys = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(bands, pa.int32()), pa.array(keys, pa.int64())], ["u", "v", "band", "key"])

    keyed = reps.select("rep", "sig", F.posexplode("bands").alias("band", "key"))
    return keyed.repartition("band", "key").sortWithinPartitions("band", "key", F.xxhash64("rep", "band")).mapInArrow(run, "u long, v long, band int, key long")


def _outsider_links(crowd: DataFrame, roots: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between components that meet under a crowded key: all members against those outside the key's largest component."""
    labelled = cut(crowd.join(roots, F.col("rep") == F.col("node"), "left").select("band", "key", "rep", F.coalesce("root", "rep").alias("root")))
    parts = labelled.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    keys = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top")).where("n > top.n")
    held = labelled.join(keys.select("band", "key", "n", (F.col("n") - F.col("top.n")).alias("out"), F.col("top.root").alias("top")), ["band", "key"])
    blocks, chunks = F.ceil(F.col("out") / BLOCK).cast("int"), F.ceil(F.col("n") / CHUNK).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    members = held.select("band", "key", "rep", "root", F.explode(upto(blocks)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), chunks).cast("int").alias("chunk"), F.lit(1).alias("late"))
    outside = held.where("root <> top").select("band", "key", "rep", "root", F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int").alias("block"), F.explode(upto(chunks)).alias("chunk"), F.lit(0).alias("late"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, own, rows, out_sigs, sets_, merged = None, [], [], [], None, [], {}

        def find(r: int) -> int:
            while merged.get(r, r) != r:
                r = merged[r]
            return r

        for b in batches:
            found = []
            for band, key, block, chunk, late, rep, root, sig, held_set in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                if last != (band, key, block, chunk):
                    last, ids, own, rows, out_sigs, sets_, merged = (band, key, block, chunk), [], [], [], None, [], {}
                mine, me = np.frombuffer(sig, np.uint8), np.frombuffer(held_set, np.uint64)
                if not late:
                    ids.append(rep)
                    own.append(root)
                    rows.append(mine)
                    sets_.append(me)
                    continue
                if not ids:
                    continue
                if out_sigs is None:
                    out_sigs = np.stack(rows)
                for k in np.flatnonzero((out_sigs == mine).mean(axis=1) >= similarity - SLACK).tolist():
                    p, q = find(root), find(own[k])
                    if p != q and jaccard(me, sets_[k]) >= similarity:
                        merged[max(p, q)] = min(p, q)
                        found.append((rep, ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], ["u", "v"])

    at = ["band", "key", "block", "chunk", "late"]
    full = outside.union(members.select(outside.columns)).join(sigs, "rep").join(sets, "rep").select(*at, "rep", "root", "sig", "set")
    return full.repartition(*at[:4]).sortWithinPartitions(*at).mapInArrow(run, "u long, v long")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, group (its least doc_id) of every document that is not alone, at the similarity given.

    Candidates are fingerprints within two bits and sketches that share a band; links are those of
    them whose sets of shingles have the similarity.
    """
    found = cut(_sketched(docs, shingle).where("doc_id IS NOT NULL"))
    reps = cut(found.groupBy("whole").agg(F.min(F.struct("doc_id", "fp", "sig", "bands")).alias("x")).select("whole", F.col("x.doc_id").alias("rep"), "x.fp", "x.sig", "x.bands"))
    by_fp = reps.groupBy("fp").agg(F.min("rep").alias("first"))
    same = reps.join(by_fp, "fp").where("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    by_code = (
        links(reps, 2)
        .join(by_fp.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u")
        .join(by_fp.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    banded = cut(_banded_pairs(reps, similarity - SLACK))
    pairs = same.union(by_code).union(banded.where("v IS NOT NULL").select("u", "v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    crowd = banded.where("v IS NULL").select("band", "key", F.col("u").alias("rep"))
    named = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).union(crowd.select("rep")).distinct()
    sets = cut(_sets(docs, reps.join(named, "rep", "left_semi"), shingle))
    near = cut(_verified(pairs, sets, similarity))
    roots = cut(components(near))
    more = cut(_outsider_links(crowd, roots, reps.select("rep", "sig"), sets, similarity))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    named = reps.join(roots, F.col("rep") == F.col("node"), "left").select("whole", "rep", F.coalesce("root", "rep").alias("group"))
    exact = found.select("doc_id", "whole").join(named, "whole").select("doc_id", "group", "rep")
    alone = exact.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return exact.join(alone, "group").select("doc_id", "group").distinct()


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with the one of the least doc_id left of each group; a null doc_id stays."""
    gone = similar(docs, shingle, similarity).where("doc_id <> group").select(F.col("doc_id").alias("_sh_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_sh_gone"), "left_anti")
