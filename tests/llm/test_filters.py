"""Quality rules, personal data and chat formatting against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidegrid.llm import chat_format, line_dedup, pii, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_equal_plain_python(make, prose):
    rows = [*prose, (300, "x y\nx y\n\n" * 9), (301, "é 漢 😀 # < >|" * 30)]
    got = quality_rules.report(make(rows)).collect()
    want = Counter((i, *naive_measures(t)) for i, t in rows)
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_keep_good_keeps_columns(make):
    good = "the cat and the dog of that house was in it for as long as on the day they had with us in time and peace"
    out = quality_rules.keep_good(make([(1, good), (2, "THE AND " * 30), (3, None), (4, "of%%% the### and$$$ " * 9)]).withColumn("n_words", F.lit("own")))
    assert [(r.doc_id, r.n_words) for r in out.collect()] == [(1, "own")]
    assert quality_rules.report(make([])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        double = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(double) % 10 == 0
    return True


def naive_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def test_pii_base_equals_plain_python(make):
    r = random.Random(4)
    bits = ["a", "b.c", "@", "@", ".", ".com", "1", "12", "255", "256", ".3", "+", "+1", "-", " ", "(", ")", "4111111111111111", "4111 1111-1111 1111", "_", "é", "😀", "\n", "%"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "a" * 3000), (903, "1" * 3000), (904, "+1" + "(" * 3000), (905, "a@b" + ".c" * 3000), (None, "x@y.zz"), (1, rows[1][1])]
    rows += [(1, "z@other.org 10.0.0.1"), (None, "q@other.org")]  # equal ids, other texts
    got = pii.report(make(rows).withColumn("term", F.lit(1)).withColumn("s", F.lit(2))).collect()
    want = Counter()
    for i, t in rows:
        base = naive_spans(t)
        joined = ",".join("%s:%d:%d" % s for s in base)
        n = Counter(s[0] for s in base)
        want[i, *(n[k] for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == want
    assert pii.report(make([])).count() == 0


def test_pii_is_linear_in_long_runs(make):
    """Runs on which the plain patterns take quadratic time; without a match each."""
    rows = [(1, "@" + "a" * 400_000), (2, "." + "1" * 400_000), (3, "+1" + "(" * 400_000)]
    assert [x.spans for x in pii.report(make(rows)).collect()] == ["", "", ""]


LETTERS = regex.compile(r"^[^\p{L}]*(\p{L}[\p{L}\p{M}'’-]+\p{L})[^\p{L}]*$")


def naive_terms(text):
    """(start, end, term) of each word that is a term once signs around it are off."""
    out = []
    for m in WORD.finditer(text or ""):
        if found := LETTERS.match(m.group()):
            out.append((m.start() + found.start(1), m.start() + found.end(1), found.group(1).lower()))
    return out


def naive_disclosure(rows, alpha=1.25, support=2):
    """The PMI rule written out over all documents: all spans of each row, and the sanitised text."""
    base = [[(k, s, e, f"{k}:{t[s:e]}") for k, s, e in naive_spans(t)] for _, t in rows]
    named = [{x[3] for x in b} for b in base]
    terms = [{x[2] for x in naive_terms(t)} for _, t in rows]
    n, n_e, n_t = len(rows), Counter(e for es in named for e in es), Counter(t for ts in terms for t in ts)
    n_te = Counter((t, e) for es, ts in zip(named, terms, strict=True) for e in es for t in ts)
    bad = {(t, e) for (t, e), k in n_te.items() if k >= support and n_e[e] >= support and math.log2(n * k / (n_t[t] * n_e[e])) >= math.log2(n / n_e[e]) / alpha - 1e-12}
    out = []
    for (i, t), b, es in zip(rows, base, named, strict=True):
        marks = [("term", s, e) for s, e, w in naive_terms(t) if any((w, x) in bad for x in es)]
        every = [x[:3] for x in b] + marks
        clean, at = "", 0
        spans = sorted((s, e, k) for k, s, e in every)
        while spans:
            s, e, k = spans.pop(0)
            while spans and spans[0][0] < e:
                e = max(e, spans.pop(0)[1])
            clean, at = clean + (t or "")[at:s] + f"<{k.upper()}>", e
        out.append((i, ",".join("%s:%d:%d" % x for x in every), clean + (t or "")[at:]))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [1000, 8])
def test_disclosing_terms_equal_brute_force(make, monkeypatch, share):
    """Entities and terms from rare to very common, far from each other, and rows that share ids."""
    monkeypatch.setattr(pii, "SHARE", share)
    r = random.Random(8)
    words = ["river,", "Ärzte", "o'neill", "x1y", "of", "stone", "light", "garden", "naïve-té", "market.", "walking", "STONE", "12th", "don't"]
    people = ["zeb@corp.example", "+49 30 1234567", "10.1.2.3", "info@shop.example", "4111111111111111"]
    rows = []
    for i in range(120):
        held = [r.choice(words) for _ in range(r.randint(0, 25))]
        for e in people[: 1 + i % 5] if i % 2 else ():
            held.insert(r.randint(0, len(held)), e)
        if "zeb@corp.example" in held and i % 4 == 1:
            held = ["Zebulon", *held, "(zebulon),"]
        if ("10.1.2.3" in held) != (r.random() < 0.03):
            held.insert(0, "(Quartz)")
        rows.append((i, r.choice([" ", "\n", "  "]).join(held)))
    rows += [(200 + i, f"only {'abcdefgh'[i]}{'ijklmnop'[i]}word u{i}@one.example") for i in range(8)]
    rows += [(5, "unrelated text without any of it"), (0, "Zebulon walks"), (None, rows[1][1]), (None, "quartz"), (3, rows[3][1]), (300, None), (301, ""), (302, "zeb@corp.example " + "quiet river " * 4000)]
    got = pii.report(make(rows)).collect()
    clean = Counter(map(tuple, pii.sanitise(make(rows)).collect()))
    want = naive_disclosure(rows)
    assert sorted(((x.doc_id, x.spans, x.sanitised_sha256) for x in got), key=str) == sorted(((i, s, hashlib.sha256(c.encode()).hexdigest()) for i, s, c in want), key=str)
    assert clean == Counter((i, c) for i, _, c in want)
    assert sum("term" in s for _, s, _ in want) > 10


def test_pii_takes_many_matches(make):
    """20,000 matches in one text, and a page of 2,000 entities with 10,000 words in two copies."""
    import time

    many = " ".join(f"u{i}@one.example" for i in range(20_000))
    page = " ".join(f"p{i}@two.example" for i in range(2000)) + " " + " ".join("".join("abcdefghij"[int(c)] for c in str(10_000 + i)) for i in range(10_000))
    began = time.time()
    got = {x.doc_id: x for x in pii.report(make([(1, many), (2, many), (3, page), (4, page)] + [(10 + i, f"word {i}") for i in range(50)])).collect()}
    for i, t in ((1, many), (3, page)):
        base = naive_spans(t)
        assert got[i].n_email == len(base) and got[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
    assert got[1].sanitised_sha256 == hashlib.sha256(" ".join(["<EMAIL>"] * 20_000).encode()).hexdigest()
    assert got[3].sanitised_sha256 == hashlib.sha256(" ".join(["<EMAIL>"] * 2000 + ["<TERM>"] * 10_000).encode()).hexdigest() == got[4].sanitised_sha256
    assert time.time() - began < 120


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "<|", "|>", "<\\|", "<\\\\|", "\\", "\n", "assistant", "é", "😀", " ", "ok", "%0A"]
    rows = [(c, t, r.choice(["user", "assistant", "sy\nst%em", "", "to<|ol"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(90, 0, None, None), (90, 1, "assistant", None)]
    got = {x.conv_id: x for x in chat_format.digests(chat(spark, rows).withColumn("m", F.lit(1))).collect()}
    for c in {x[0] for x in rows}:
        turns = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        digest = hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        learned = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat_format.digests(chat(spark, [])).count() == 0


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see <|image|> ", None, 0), ("image", None, "a.png", 2), ("audio", None, "b.wav", 3), ("document", None, "c.pdf", 1), (None, "rest", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:int>>")
    row = chat_format.format_conversations(df).first()
    assert "see <\\|image|> <|image|><|audio|><|document|>rest" in row.formatted
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 75), ("document", "c.pdf", 512)]


@pytest.mark.parametrize("operator", [quality_rules.report, pii.report, line_dedup.report, lambda d: chat_format.digests(d.selectExpr("doc_id conv_id", "0L turn", "lang role", "text"))])
def test_native_plans_have_no_python(make, operator):
    plan = operator(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
