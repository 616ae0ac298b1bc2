"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import line_dedup, simhash, substring_dedup
from tidegrid.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_substrings(rows, n):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for j in range(len(w) - n + 1):
                k = tuple(w[j : j + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        keep = [True] * len(w)
        if i is not None:
            for j in range(len(w) - n + 1):
                if first[tuple(w[j : j + n])] < i:
                    keep[j : j + n] = [False] * n
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(make, prose):
    got = sorted((tuple(r) for r in substring_dedup.report(make(prose)).collect()), key=str)
    assert got == naive_substrings(prose, 50)
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize("window", [3, 12, 20])
def test_other_windows_and_crowded_shards(make, prose, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOAD", 50)
    monkeypatch.setattr(substring_dedup, "BLOCK", 8)
    rows = [x for x in prose if x[0] not in (204, 205)]
    got = substring_dedup.remove_repeats(make(rows), window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == naive_substrings(rows, window)


def test_periodic_texts_stay_within_blocks(make, monkeypatch):
    """Texts whose windows share one anchor: shards and rows are bounded by the block, and nothing is lost."""
    r = random.Random(5)
    words = lambda n: " ".join(r.choice("abcdefgh") * 2 for _ in range(n))
    rows = [(1, "x y " * 900 + words(40)), (2, words(30) + " " + "x y " * 700), (3, "y x " * 50 + words(60) + " x y" * 20), (4, "z " * 1200), (5, words(5) + " z" * 700 + " " + words(5)), (6, "x y z " * 100), (8, "z " * 300)]
    late = words(90)  # in two rows of one id, in other blocks of each
    rows += [(0, late + " x" + words(200)), (0, words(300) + " " + late), (7, words(3) + " " + late + " " + words(3))]
    sent = []
    whole = substring_dedup._sent
    monkeypatch.setattr(substring_dedup, "_sent", lambda *a: sent.append(whole(*a).cache()) or sent[-1])
    got = substring_dedup.remove_repeats(make(rows), 20, block=64).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == naive_substrings(rows, 20)
    spans = sent[0].select("owner", "block", "copy", "kind", F.size(F.split(F.col("words").cast("string"), " ")).alias("n"), "doc", "th").collect()
    assert max(x.n for x in spans) <= 64 + 19
    shards = Counter()
    for x in spans:
        if x.kind == 0:
            shards[x.owner, x.block, x.copy] += x.n
    assert max(n for k, n in shards.items() if k[0]) <= 64 + 19 and len(spans) > 100  # the id 0 has two rows


def test_suffix_automaton():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 40))] for _ in range(2))
        m = substring_dedup.SuffixAutomaton()
        m.extend(a)
        for n in (1, 3, 5):
            held = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
            assert m.reaches(b, n) == [tuple(b[i : i + n]) in held for i in range(len(b) - n + 1)]


def text_hash(text):
    """The hash that orders rows of one doc_id; a null text has none."""
    return 0 if text is None else (xxhash.xxh64_intdigest(text.encode(), 42) ^ 1 << 63) - (1 << 63)


def naive_lines(rows, n=3):
    """{(doc_id, text): text without the lines of later windows}."""
    seen, drop, spans = {}, {}, {}
    for i, t in set(rows):
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        for a in range(len(lines) - n + 1):
            at = ((i is not None, i or 0), text_hash(t), lines[a][0])
            key = tuple(x for _, x in lines[a : a + n])
            seen[key] = min(seen.get(key, at), at)
            spans.setdefault(key, []).append((at, (i, t), [k for k, _ in lines[a : a + n]]))
    for key, found in spans.items():
        for at, row, ks in found:
            if at > seen[key]:
                drop.setdefault(row, set()).update(ks)
    return {(i, t): "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop.get((i, t), ())) for i, t in rows}


def test_line_dedup_equals_brute_force(make):
    r = random.Random(3)
    line = lambda: r.choice(["", "a b", "c", " ", "d e f", "g", "h i"])
    rows = [(i, "\n".join(line() for _ in range(r.randint(0, 14)))) for i in range(40)] + [(99, None), (98, ""), (None, "a b\nc\nd e f\ng")]
    rows += [(97, "x\n" * 5000), (1, rows[1][1]), (None, "a b\nc\nd e f\ng")]
    # Equal ids, null ones too, with other texts: no row may lose lines that only another row repeats.
    rows += [(5, "own 1\nown 2\nown 3\nown 4"), (5, "a b\nc\ng\nown 5"), (None, "free 1\nfree 2\nfree 3"), (None, "free 1\nfree 2\nfree 3\nfree 4")]
    out = line_dedup.without_repeats(make(rows).withColumn("w", F.lit(1)).withColumn("i", F.lit(2))).collect()
    want = naive_lines(rows)
    assert len(out) == len(rows)
    assert Counter((x.doc_id, x.text) for x in out) == Counter((i, None if t is None else want[i, t]) for i, t in rows)
    assert all(x.w == 1 and x.n_chars == (None if x.text is None else len(x.text)) for x in out)
    assert (5, "own 1\nown 2\nown 3\nown 4") in {(x.doc_id, x.text) for x in out}
    assert line_dedup.without_repeats(make([])).count() == 0


def naive_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps, most=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= most):
            x, y = find(i), find(i + 1 + int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash_equals_brute_force(make, prose):
    rows = [x for x in prose if x[0] not in (None, 204, 205)]
    fps = [naive_fingerprint(t) for _, t in rows]
    roots = naive_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert sorted(map(tuple, simhash.report(make(rows)).collect())) == want
    assert simhash.report(make([])).count() == 0


def test_golay_code_is_perfect():
    errors = simhash._errors()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3
    r = random.Random(2)
    for _ in range(200):
        a = r.getrandbits(23)
        b = a ^ (1 << r.randrange(23)) if r.random() < 0.9 else a
        x, y = (set(simhash.golay_indices(np.array([v]))[0].tolist()) for v in (a, b))
        assert x & y


@pytest.mark.parametrize("cap", [128, 4])
def test_crowded_keys_lose_no_link(spark, cap, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", cap)
    r = random.Random(5)
    near = lambda x: x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
    fps = sorted({near(b) for b in [r.getrandbits(64) for _ in range(4)] for _ in range(150)} | {r.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    got, want = {}, {}
    for x, r_ in zip(signed, naive_components(fps), strict=True):
        got.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(r_, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100}


def test_near_duplicates_at_similarity(make):
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    base = words(300)
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # a crowd of edited copies, each about 0.93 like the base
        w = list(base)
        for _ in range(2):
            w[r.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    clean = [(1000 + i, " ".join(words(200))) for i in range(40)]
    rows += clean + [(2000, None), (2001, ""), (None, rows[0][1])]
    kept = {x.doc_id for x in simhash.drop_similar(make(rows).withColumn("rep", F.lit(0)).withColumn("fp", F.lit(0))).collect()}
    assert kept == {0, None, 2000} | {i for i, _ in clean}


def naive_groups(rows, least=0.8):
    """Groups by the exact similarity of five-word shingles, all pairs compared."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    members = {}
    for (i, _), x in zip(rows, root, strict=True):
        members.setdefault(x, set()).add(i)
    return sorted(sorted(m) for m in members.values() if len(m) > 1)


def found_groups(make, rows):
    members = {}
    for x in simhash.similar(make(rows)).collect():
        members.setdefault(x.group, set()).add(x.doc_id)
    return sorted(map(sorted, members.values()))


def edited(r, words, n, tag):
    out = list(words)
    for k in range(n):
        out[r.randrange(len(out))] = f"{tag}_{k}"
    return out


def test_links_have_the_exact_similarity(make):
    r = random.Random(21)
    rows = []
    for i in range(150):  # pairs on both sides of 0.8
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(r, base, r.randint(3, 6), f"n{i}")))]
    assert 20 < len(want := naive_groups(rows)) < 130
    assert found_groups(make, rows) == want


@pytest.mark.parametrize("batch", [10_000, 7])
def test_crowds_of_several_families_lose_no_pair(spark, make, batch):
    r = random.Random(22)
    licence = [f"l{i}" for i in range(120)]  # under 0.8 of every text, but often a whole band
    rows = [(i, " ".join(licence + [f"a{i}_{k}" for k in range(48)])) for i in range(150)]
    for f in range(40):
        tail = [f"f{f}_{k}" for k in range(48)]
        rows += [(1000 + 2 * f + k, " ".join(licence + edited(r, tail, 1, f"{f}_{k}"))) for k in range(2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert found_groups(make, rows) == (want := naive_groups(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) == 40
