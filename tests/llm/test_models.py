"""Decontamination, sampled segmentations and the two classifiers."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, quality_classifier, sentencepieces, toxicity


@pytest.fixture(scope="module")
def items():
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "rt", "sh", "l")]
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    return [(i, f"{say(r.randint(9, 18))} {say(r.randint(4, 8))}") for i in range(60)], words


def shard_of(bench):
    """All items as one index, counted in plain Python."""
    split = [(i, *decontaminate.split_item(t)) for i, t in bench]
    df = Counter(w for _, q, a in split for w in set(q + a))
    sizes = [len(q) + len(a) for _, q, a in split]
    return decontaminate.Index([(i, q, a, df) for i, q, a in split], len(split), sum(sizes) / len(sizes), max(sizes)), df


def test_wand_finds_what_scoring_all_finds(items):
    index, _ = shard_of(items[0])
    r = random.Random(1)
    for _ in range(150):
        terms = r.sample(range(len(index.terms)), 30)
        if r.random() < 0.7:
            terms += [index.terms[w] for w in map(decontaminate.normal, r.choice(items[0])[1].encode().split()) if w in index.terms]
        terms = sorted(set(terms))
        scores = {}
        for t in terms:
            for held in index.postings[t].values():
                for d, x in held:
                    scores[d] = scores.get(d, 0) + x
        for bound in (0.2, 0.5):
            assert sorted(d for d, _ in index.wand(terms, bound)) == sorted(d for d, x in scores.items() if x >= bound - 1e-9)


def naive_leaks(rows, bench):
    """Every passage scored against every item with BM25 written out, then the check of question and answer."""
    split = {k: decontaminate.split_item(t) for k, t in enumerate(t for _, t in bench)}
    words = {k: q + a for k, (q, a) in split.items() if q or a}
    n, mean, longest = len(words), sum(map(len, words.values())) / len(words), max(map(len, words.values()))
    df = Counter(w for ws in words.values() for w in set(ws))

    def weight(w, ws):
        tf = ws.count(w)
        return np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))

    shares = {}
    for k, ws in words.items():
        each = {w: weight(w, ws) for w in set(ws)}
        shares[k] = {w: x / sum(each.values()) for w, x in each.items()}

    def covered(part, size, passage):
        size = min(size, len(part))
        wanted = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)} if size else set()
        held = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        return len(wanted & held) >= 0.5 * len(wanted)

    out = []
    for i, text in rows:
        ws = (text or "").encode().split()
        found = set()
        for c in range(max(1, -(-len(ws) // longest) - 1)):
            passage = [x for x in map(decontaminate.normal, ws[c * longest : (c + 2) * longest]) if x]
            held = set(passage)
            for k, share in shares.items():
                if sum(x for w, x in share.items() if w in held) >= 0.5 and covered(split[k][0], 5, passage) and covered(split[k][1], 3, passage):
                    found.add(bench[k][0])
        out.append((i, tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_chars", [2_000_000, 600])
def test_report_equals_brute_force_at_any_number_of_shards(make, spark, items, monkeypatch, shard_chars):
    bench, words = items
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = []
    for i in range(60):  # whole, cut short, or with words changed
        item = bench[i][1].split()
        for _ in range(r.randint(0, len(item) // 2)):
            item[r.randrange(len(item))] = r.choice(words)
        rows.append((i, f"{noise(r.randint(0, 90))} {' '.join(item[r.randint(0, 4) :])} {noise(r.randint(0, 90))}"))
    rows += [(100 + i, noise(r.randint(1, 400))) for i in range(60)] + [(1, bench[4][1]), (None, bench[6][1]), (None, None), (7, "")]
    table = [*bench, (3, bench[9][1]), (61, bench[9][1])]  # an id with two texts, a text with two ids
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard_chars)
    got = decontaminate.report(make(rows), spark.createDataFrame([*table, table[0], (98, None), (99, " .. ")], "item_id long, text string")).collect()
    assert sorted(((x.doc_id, tuple(x.item_ids)) for x in got), key=str) == naive_leaks(rows, table)
    assert all(x.contaminated == bool(x.item_ids) for x in got) and sum(x.contaminated for x in got) > 10


def test_first_sums_cut_into_parts_lose_nothing(items):
    """A text whose first sums don't fit one step, with gaps between the parts."""
    bench, words = items
    index, _ = shard_of(bench)
    number = np.full(400_000, -1, np.int64)
    placed = [index.terms.get(decontaminate.normal(w), -1) for w in bench[3][1].encode().split()]
    for at in (5, 90_000, 399_000):
        number[at : at + len(placed)] = placed
    number[200_000:300_000] = np.arange(100_000) % len(index.terms)
    live = dict(index.candidates(number))
    assert all(any(3 // decontaminate.BLOCK in live.get(c, ()) for c in (at // index.longest - 1, at // index.longest)) for at in (5, 90_000, 399_000))


def test_leaks_are_found_and_clean_texts_left_alone(make, spark, items):
    bench, words = items
    r = random.Random(2)
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, f"{noise(r.randint(0, 200))} {bench[i][1]}%%% {noise(r.randint(0, 200))}") for i in range(20)]
    rows += [(100 + i, noise(r.randint(1, 300))) for i in range(60)] + [(200, None), (201, ""), (202, " ".join(bench[5][1].split()[:-3])), (None, bench[7][1])]
    rows.append((203, f"{noise(20_000)} {bench[8][1]} {noise(50)}"))
    docs, table = make(rows).withColumn("item_id", F.lit(0)), spark.createDataFrame([*bench, (98, None), (99, "")], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.report(docs, table).collect()}
    assert all(i in got[i].item_ids for i in range(20))
    assert got[None].item_ids == [7] and 8 in got[203].item_ids
    assert not any(got[i].contaminated for i in (*range(100, 160), 200, 201))
    kept = decontaminate.drop_leaks(docs, table)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} >= set(range(100, 160))
    assert decontaminate.drop_leaks(docs, table.limit(0)).count() == len(rows)


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepieces.model_path(), "rb") as f:
        return sentencepieces.Encoder(f.read())


TEXTS = ["a  b", "  lead", "trail ", "trail   ", "", "   ", " ", "é漢 x", "tab\there\n\n x ", "x" * 300, "▁a ▁", "\x00a", "漢😀𐍈", "The quick brown fox jumps over 12 lazy dogs. " * 30]


def test_encoding_equals_the_library_and_decodes(pieces):
    for t in TEXTS:
        ids = pieces.encode(t)
        assert ids.tolist() == pieces.processor.encode(t)
        assert pieces.decode(ids) == t.replace("▁", " ")


def test_samples_are_distinct_segmentations(pieces):
    drawn = pieces.samples(TEXTS, sentencepieces.row_seeds(list(range(len(TEXTS)))), 4)
    for t, found in zip(TEXTS, drawn, strict=True):
        paths = [tuple(ids.tolist()) for ids, _, _ in found]
        assert len(set(paths)) == len(paths) >= 1
        assert all(pieces.decode(np.array(p, np.int64)) == t.replace("▁", " ") for p in paths)
        assert all(0 < q <= 1 for _, _, q in found)


def naive_segmentations(pieces, word):
    """{ids: probability} of all ways to write a word as vocabulary pieces."""
    of = {pieces.processor.id_to_piece(i): i for i in range(pieces.processor.vocab_size())}
    text, weight, out = "▁" + word, lambda i: (i + 3.0) ** -sentencepieces.ALPHA, {}

    def go(at, ids, w):
        if at == len(text):
            out[tuple(ids)] = w
            return
        for end in range(at + 1, len(text) + 1):
            if (i := of.get(text[at:end])) is not None:
                go(end, [*ids, i], w * weight(i))
        if text[at] not in of:
            raw = [of[f"<0x{x:02X}>"] for x in text[at].encode()]
            go(at + 1, ids + raw, w * float(np.prod([weight(i) for i in raw])))

    go(0, [], 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


@pytest.mark.parametrize("word", ["a", "that", "idiots", "é漢x", "walking"])
def test_the_lattice_holds_every_segmentation(pieces, word):
    """All segmentations come out if that many are asked for, among them those that cross the canonical pieces' borders."""
    want = naive_segmentations(pieces, word)
    (found,) = pieces.samples([word], sentencepieces.row_seeds([1]), len(want) + 5)
    assert {tuple(ids.tolist()): pytest.approx(np.exp(lp), rel=1e-9) for ids, lp, _ in found} == want
    assert all(q == 1.0 for _, _, q in found)


def test_long_words_and_texts(pieces):
    texts = ["ab" * 4000, "漢" * 2000, "word " * 3000]
    drawn = pieces.samples(texts, sentencepieces.row_seeds([1, 2, None]), 3)
    assert [[pieces.decode(ids) for ids, _, _ in found] for found in drawn] == [[texts[0]] * 3, [texts[1]], [texts[2]] * 3]


def test_samples_depend_on_the_row_alone(pieces):
    texts = ["the river and the stone", "walking in light", "the river and the stone"]
    whole = pieces.samples(texts, sentencepieces.row_seeds([5, 6, 5]), 3)
    alone = [pieces.samples([t], sentencepieces.row_seeds([d]), 3)[0] for t, d in zip(texts, [5, 6, 5], strict=True)]
    as_lists = lambda rows: [[(ids.tolist(), lp, q) for ids, lp, q in r] for r in rows]
    assert as_lists(whole) == as_lists(alone) and as_lists(whole)[0] == as_lists(whole)[2]


def test_inclusion_scores_are_unbiased(pieces):
    """Horvitz-Thompson: probabilities over inclusion scores sum to one on average; first samples follow the distribution."""
    n, text = 6000, "that in"
    drawn = pieces.samples([text] * n, sentencepieces.row_seeds(list(range(n))), 2)
    assert np.mean([sum(np.exp(lp) / q for _, lp, q in found) for found in drawn]) == pytest.approx(1, abs=0.02)
    a, b = (naive_segmentations(pieces, w) for w in ("that", "in"))
    want = {x + y: p * q for x, p in a.items() for y, q in b.items()}
    first, second = ([tuple(found[i][0].tolist()) for found in drawn] for i in (0, 1))
    for ids, p in sorted(want.items(), key=lambda x: -x[1])[:4]:
        assert first.count(ids) / n == pytest.approx(p, abs=0.02)
        # The second of two drawn without replacement.
        rest = sum(q * p / (1 - q) for other, q in want.items() if other != ids)
        assert second.count(ids) / n == pytest.approx(rest, abs=0.02)


def test_encoding_rows(make):
    rows = [(1, "some text here"), (1, "some text here"), (2, None), (3, ""), (None, "x y"), (4, "word " * 20_000)]
    out = sorted(sentencepieces.report(make(rows).withColumn("ids", F.lit(0))).collect(), key=str)
    assert len(out) == len(rows) and all(r.restored for r in out)
    one = [r for r in out if r.doc_id == 1]
    assert one[0] == one[1]
    assert sentencepieces.report(make([])).count() == 0


def labelled_rows(label):
    r = random.Random(3)
    words = ["the", "house", "of", "river", "stone", "and", "light", "garden", "was", "walking", "in", "old", "market"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        if bad and label == "toxic":
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["grumblefool", "Nastykins!", "vilewretch"]))
        if bad and label == "quality":
            text = [w.upper() + "!!" if i % 8 else w + "###" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not bad) if label == "quality" else 1, int(bad) if label == "toxic" else 0))
    return rows, labels


@pytest.mark.parametrize(("operator", "label"), [(toxicity.report, "toxic"), (quality_classifier.report, "quality")])
def test_classifiers_on_held_out_rows(make, spark, operator, label):
    rows, labels = labelled_rows(label)
    extra = [(900, None), (901, ""), (902, "stone " * 30_000), (None, "house"), (5, rows[5][1])]
    table = spark.createDataFrame([*labels, (903, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = operator(make([*rows, *extra]).withColumn("y", F.lit(1)), table).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {x[0]: x[1 if label == "quality" else 2] for x in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) and len(held) > 50
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1


@pytest.mark.parametrize("operator", [toxicity.report, quality_classifier.report])
def test_classifiers_without_labels_or_rows(make, spark, operator):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in operator(make([(1, "a b"), (2, None)]), none).collect()} <= {0.5}
    assert operator(make([]), none).count() == 0


def test_only_one_label(make, spark):
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = make([(i, f"word {i}") for i in range(20)])
    assert all(r.score < 0.1 for r in toxicity.report(docs, one).collect())
    assert all(r.score > 0.9 for r in quality_classifier.report(docs, one).collect())


def test_neighbour_counts_do_not_saturate(make):
    """More than 2**24 equal pairs in one task, beside rarer ones."""
    many, mixed = "a " * 100_000, "a 7 " * 50_000
    (form_a, shape_a), (form_7, shape_7) = (quality_classifier.terms(w) for w in (b"a", b"7"))
    index = quality_classifier.index_vectors()
    want = 2 * 90 * 99_999 * (index[form_a] + index[shape_a]) + 10 * 99_999 * (index[form_7] + index[shape_7])
    got = quality_classifier.word_vectors(make([(i, many if i < 90 else mixed) for i in range(100)]).coalesce(1))
    assert np.allclose(got[shape_a], want / np.linalg.norm(want), atol=1e-9)


def naive_kneser_ney(rows, discount=0.75, order=7):
    """P(word | class) from counters of strings: rows are (word bytes, class or None)."""
    def runs(w):
        padded = b" " * (order - 1) + w + b" "
        return [padded[i : i + order] for i in range(len(w) + 1)]

    top, shared = [Counter(), Counter()], [None] * (order + 1)
    seen = set()
    for w, y in rows:
        for g in runs(w):
            seen.add(g)
            if y is not None:
                top[y][g] += 1
    for n in range(order - 1, 0, -1):
        shared[n] = Counter(g[1:] for g in seen)
        seen = set(shared[n])

    def p(counts, g, lower):
        total = sum(c for x, c in counts.items() if x[:-1] == g[:-1])
        if not total:
            return lower
        kinds = sum(1 for x in counts if x[:-1] == g[:-1])
        return max(counts[g] - discount, 0) / total + discount * kinds / total * lower

    def chance(g, y):
        out = 1 / 256
        for n in range(1, order):
            out = p(shared[n], g[-n:], out)
        return p(top[y], g, out)

    return chance, lambda w: sum(np.log(chance(g, 1) / chance(g, 0)) for g in runs(w))


KN_ROWS = [(b"idiot", 1), (b"idiots", 1), (b"the", 1), (b"the", 0), (b"then", 0), (b"river", 0), (b"stone", 0), (b"stone", 0), (b"clown", None), (b"idea", None), (b"the", None), (b"", 0)]


def test_kneser_ney_equals_brute_force(spark):
    texts = spark.createDataFrame([(w.decode() or "...", y) for w, y in KN_ROWS], "text string, y int")
    model = toxicity.gathered(toxicity.kneser_ney(toxicity._count(texts)))
    chance, ratio = naive_kneser_ney(KN_ROWS)
    words = [b"idiot", b"the", b"stones", b"clown", b"unseen", b"\xc3\xa9t\xc3\xa9", b""]
    assert toxicity.ratios(model, words).tolist() == pytest.approx([ratio(w) for w in words], rel=1e-6, abs=1e-9)
    assert abs(ratio(b"zzzz")) < 1e-9  # unknown to both classes: shared counts alone
    for context in (b"      ", b"  idio", b"   the", b"qqqqqq", b"    st"):
        grams = [context + bytes([b]) for b in range(256)]
        assert all(sum(chance(g, y) for g in grams) == pytest.approx(1) for y in (0, 1))


def test_toxicity_score_equals_brute_force(make, spark, monkeypatch):
    """Scores of all documents, from counters, sorted lists and gradient descent."""
    r = random.Random(21)
    calm, rude = [f"{a}{b}r" for a in "bdfg" for b in ("a", "en", "io")], ["idiot", "moron", "trash"]
    rows, toxic = [], {}
    for i in range(240):
        toxic[i] = int(i % 3 == 0)
        ws = [r.choice(calm) for _ in range(r.randint(4, 14))]
        if toxic[i] and r.random() < 0.8 or r.random() < 0.1:
            ws.insert(r.randint(0, len(ws)), r.choice(rude))
        rows.append((i, " ".join(ws)))
    rows += [(900, None), (901, ""), (902, "Moron!")]
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score(make(rows), labels).collect()}
    part = {x.doc_id: x.p for x in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").select("doc_id", toxicity.labelled.part().alias("p")).collect()}
    learnt = [i for i in toxic if zlib.crc32(str(i).encode()) % 5]
    words = {i: [toxicity.normal(w) for w in (t or "").encode().split()] for i, t in rows}
    counted = [i for i in learnt if part[i] >= toxicity.KEPT_BACK]
    _, ratio = naive_kneser_ney([(w, toxic[i] if i in counted else None) for i, ws in words.items() for w in ws])
    known = {w: ratio(w) for ws in words.values() for w in ws}

    def evidence(ws):
        x = sorted((known[w] for w in ws), reverse=True)
        if not x:
            return [0.0] * toxicity.WIDTH
        tops = [sum(x[:t]) / t for t in toxicity.TOPS]
        over = [sum(v > o for v in x) for o in toxicity.OVER]
        return [sum(x) / len(x), math.log(len(x)), *tops, *(o / len(x) for o in over), *(math.log1p(o) for o in over)]

    fit = [i for i in learnt if part[i] < toxicity.KEPT_BACK]
    x, y = np.array([evidence(words[i]) for i in fit]), np.array([toxic[i] for i in fit], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    pull = np.append(np.full(x.shape[1], 0.01 * len(x) / 10), 0)  # the ridge, as the operator weighs it
    for _ in range(60_000):
        w -= 0.5 / len(x) * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + pull * w)
    for i, ws in words.items():
        want = 1 / (1 + math.exp(-float(np.append((np.array(evidence(ws)) - mean) / scale, 1) @ w)))
        assert got[i] == pytest.approx(want, abs=2e-3), i


def test_counted_texts_are_bounded_by_bytes(make, spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED_BYTES", 250)
    docs = make([(i, "x" * 100) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    taken = toxicity._counting(toxicity.labelled.keyed(docs), labels, "toxic").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in taken} == {0: 2, 1: 2}


def test_toxicity_learns_from_every_labelled_text(make, spark, monkeypatch):
    """Neither bounds of a choice nor the cut into chunks move a score; equal texts are scored alike."""
    rows, labels = labelled_rows("toxic")
    docs, table = make([*rows, (950, rows[3][1]), (951, None)]), spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    whole = {r.doc_id: r.score for r in toxicity.score(docs, table).collect()}
    assert whole[950] == whole[3]
    for name, value in (("COUNTED", 4), ("COUNTED_BYTES", 400), ("CHUNK", 3000), ("CHUNK_ROWS", 7)):
        monkeypatch.setattr(toxicity, name, value, raising=False)
    again = {r.doc_id: r.score for r in toxicity.score(docs, table).collect()}
    assert again == pytest.approx(whole, rel=1e-9)


def test_toxicity_exchanges_packed_columns(make, spark):
    """What is exchanged of texts, words and n-grams is smaller than the texts, and is read back as it was."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(400))) for i in range(200)] + [(None, "a"), (200, None), (201, "")]
    chunks = toxicity._chunks(make(rows).coalesce(1))
    own, sent = chunks.where("of = -1").collect(), chunks.where("of >= 0")
    sizes, numbers, times, bounds = toxicity._texts(own[0].asDict())
    known = [w for row in sorted(sent.collect(), key=lambda x: x.to) for w in bytes(toxicity._unpack(row.packed)[0]).split(b"\n")]
    edges = np.cumsum([0, *sizes])
    back = {d: Counter({known[i]: n for i, n in zip(numbers[a:b].tolist(), times[a:b].tolist(), strict=True)}) for d, a, b in zip(own[0].docs, edges, edges[1:], strict=False)}
    assert len(own) == 1 and bounds.sum() == len(known) and back == {i: Counter(toxicity.normal(w) for w in (t or "").encode().split()) for i, t in rows}
    grams = toxicity._grams(sent, toxicity._classed(chunks, spark.createDataFrame([(1, 1, 0)], "doc_id long, y0 int, y1 int")))
    text = sum(len(t or "") for _, t in rows)
    assert sum(len(x.packed) for x in [*own, *sent.collect()]) < text / 3 and sum(len(x.packed) for x in grams.collect()) < text / 3


def test_lattice_that_outgrows_its_room(pieces):
    """Rows set aside at first are a matter of memory: a lattice that has to grow draws the same."""
    words = [f"▁{a}{b}" for a in ("stone", "été", "run", "x") for b in range(40)]
    small, large = (sentencepieces.Lattice(pieces.processor, room=n) for n in (3, 1 << 16))
    roots = [lattice.add(words) for lattice in (small, large)]
    assert (roots[0] == roots[1]).all() and small.chances.n == large.chances.n > 3
    keys = sentencepieces.row_seeds(list(range(len(words))))
    for a, b in zip(small.walk(roots[0], keys), large.walk(roots[1], keys), strict=True):
        assert (a == b).all()
    assert (small.p[: small.chances.n] == np.exp(small.logp[: small.chances.n])).all()
