"""Byte-pair encoding, sort-means and resampling for a target distribution."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import pair_bpe, sort_means, target_sampling


# Byte-pair encoding -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pair_bpe.vocabulary_path())


TEXTS = [
    None, "", " \n", "Hello, wörld!  it's 12 o'clock\tNOW", "aaaa" * 300, "x" * 20_000, "a<|endoftext|>B <|startoftext|><|startoftext|>", "ΑΣ ΣΑΣ. İstanbul ǅ", "é é ﬁ",
    "'S'T'RE 'll don't''d", "１２ ²³ Ⅷ ٢", "\x00\x1c\x1d\x85​| z", "日本語のテキスト 한국어 עברית", "😀👩‍👩‍👧 ퟿", "՘Ᲊ\U00010d50 ࢏", "the the the\n\nthe",
]


def test_bpe_equals_the_library(make, library, prose):
    rows = list(enumerate(TEXTS)) + [(100 + i, t) for i, (_, t) in enumerate(prose)] + [(None, "null id"), (3, TEXTS[3])]
    got = pair_bpe.report(make(rows)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pair_bpe.report(make([])).count() == 0
    coded = pair_bpe.encode(make(rows[:8]))
    assert {x.doc_id: x.text for x in pair_bpe.decode(coded).collect()} == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows[:8]}


def test_pair_index_where_a_merge_makes_a_lower_rank():
    """Merges out of order, against merging the lowest rank's first place again and again."""
    base = {s: i for i, s in enumerate(pair_bpe.byte_symbols())}
    base |= {f"{s}</w>": 256 + i for s, i in list(base.items())}
    r = random.Random(3)
    for _ in range(40):
        merges, ids = [], dict(base)
        pool = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        while len(merges) < 14:
            a, b = r.choice([s for s in pool if not s.endswith("</w>")]), r.choice(pool)
            if [a, b] not in merges:
                merges.append([a, b])
                ids.setdefault(a + b, len(ids))
                pool.append(a + b)
        r.shuffle(merges)
        import json

        v = pair_bpe.Vocabulary(json.dumps({"added_tokens": [], "model": {"vocab": ids, "merges": merges, "end_of_word_suffix": "</w>"}}).encode())
        rank = {tuple(m): k for k, m in enumerate(merges)}
        for _ in range(20):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            parts = [*word[:-1], word[-1] + "</w>"]
            while found := [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]:
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            words = [word.encode()] if not v.ordered else [word.encode(), b"ab", word.encode()]
            coded = list(pair_bpe.PairIndex(v, words).ids())
            assert np.frombuffer(coded[0], "<u4").tolist() == [ids[p] for p in parts] and coded[-1] == coded[0]


# Sort-means -----------------------------------------------------------------------------


def naive_clusters(rows, clusters, rounds, dimensions):
    """Whole vectors in Python integers, each against every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-sort_means.MOST, min(sort_means.MOST, math.floor(1024 * x))) for x in v]))
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[k]) for x in zip(*held[k])] if k in held else c for k, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


@pytest.mark.parametrize("spread", [1.0, 50_000.0])
def test_clusters_equal_brute_force(spark, spread):
    r = random.Random(11)
    rows = [(i, [r.gauss(3 * (i % 4), 1) * spread for _ in range(5)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(7, [1.0] * 5), (7, [2.0] * 5), (None, [0.5] * 5), (400, [-2.0] * 5)]
    rows += [(500, None), (501, []), (502, [1.0] * 4), (503, [1.0] * 6), (504, [1.0, None, 1.0, 1.0, 1.0]), (505, [float("nan")] * 5), (506, [float("inf")] + [0.0] * 4), (507, [1e30] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", pytest.importorskip("pyspark.sql.functions").lit(1))
    found, centroids = sort_means.cluster(df.repartition(5), clusters=6, rounds=4, dimensions=5)
    want, means = naive_clusters(rows, 6, 4, 5)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert centroids.tolist() == means


def test_clusters_of_few_vectors(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sort_means.report(df([])).count() == 0 and sort_means.report(df([(1, [0.0] * 3)])).count() == 0
    got = sort_means.report(df([(i, [0.25] * 64) for i in range(5)])).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 5


def test_scan_stops_and_misses_nothing():
    r = np.random.default_rng(2)
    x = r.integers(-50, 50, (2000, 3)) + 400 * r.integers(0, 12, (2000, 1))
    c = np.concatenate([r.integers(-30, 30, (12, 3)) + 400 * np.arange(12)[:, None], [[0, 0, 0], [0, 0, 0]]])
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    best, least, took = sort_means.assign(x, c, d.argmin(1))
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all() and took < len(x) * 6
    best, _, _ = sort_means.assign(x, c, r.integers(0, 14, 2000))
    assert (best == d.argmin(1)).all()


# Resampling -------------------------------------------------------------------------------


def naive_resample(rows, target, buckets, longest, percent, least):
    def features(t):
        words = pytest.importorskip("regex").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    held = [(i, n, *features(t)) for n, (i, t) in enumerate(rows)]
    s, t = Counter(b for *_, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    total, sought = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (sought + buckets))))
    out = []
    for i, n, words, f in held:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least, n])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = {x[5]: k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x[:4], drawn.get(x[5])) for x in out]


@pytest.mark.parametrize(("buckets", "longest", "percent"), [(10_000, 1, 10), (50, 2, 60)])
def test_resampling_equals_brute_force(make, spark, prose, monkeypatch, buckets, longest, percent):
    monkeypatch.setattr(target_sampling, "SALTED", 2)
    rows = [x for x in prose if x[0] not in (3,) or x[1] != prose[3][1]][:140] + [(700, "ÄB aB ab-1 _x９ x"), (701, None), (702, "hot " * 3000), (703, "hot " * 25)]
    target = [rows[1][1], rows[62][1], None, "hot ab", ""]
    docs, aim = make(rows).repartition(6), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = target_sampling.resample(docs, aim, percent, 20, buckets, longest).collect()
    want = naive_resample(rows, target, buckets, longest, percent, 20)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[4] is not None for x in want) >= 5


def test_resampling_blocks_are_dealt_alike(make, spark, prose, monkeypatch):
    """Small blocks and large ones give one result; an empty table gives none."""
    rows = [x for x in prose if x[0] is not None and x[1]]
    aim = spark.createDataFrame([(rows[5][1],)], "text string")
    run = lambda: sorted(map(tuple, target_sampling.resample(make(rows), aim, 30).collect()), key=str)
    one = run()
    monkeypatch.setattr(target_sampling, "BLOCK_FEATURES", 300)
    assert run() == one
    assert target_sampling.report(make([]), aim).count() == 0
    monkeypatch.undo()
    assert sorted(map(tuple, target_sampling.resample(make(rows), aim.limit(0), 30).collect()), key=str) == sorted(naive_resample(rows, [], 10_000, 1, 30, 20), key=str)


def test_packed_postings_come_back():
    for counts in ([1, 2, 255], [1, 70_000, 3]):
        places, n = np.array([0, 9, 65_535]), np.array(counts)
        got = target_sampling._unpacked(target_sampling._packed(places, n))
        assert got[0].tolist() == places.tolist() and got[1].tolist() == counts


def test_first_pairs_are_indexed_at_once(library):
    """The places of all words' first pairs come of one table; ASCII texts are split as the library splits them."""
    v = pair_bpe.Codec(pair_bpe._file(None)).v
    words = [b"running", b"a", b"aaaa", b"x1", "\u00e9t\u00e9".encode(), b"running"]
    index = pair_bpe.PairIndex(v, words)
    ids = [[*(v.inner[b] for b in w[:-1]), v.last[w[-1]]] for w in words]
    want = {}
    for at, (a, b) in enumerate(pair for w in ids for pair in zip(w, [*w[1:], None], strict=True)):
        if b is not None and (a, b) in v.rank:
            want.setdefault(v.rank[a, b], []).append(at)
    assert index.places == want
    assert (v.first_ranks >= 0).sum() == sum(a in v.base and b in v.base for a, b in v.rank)
    text = "".join(chr(c) + t for c in range(128) for t in ("ab", "'s", " ", "1", "'RE"))
    assert pair_bpe.Codec(pair_bpe._file(None)).encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
