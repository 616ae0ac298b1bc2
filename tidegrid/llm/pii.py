"""Personal data: pattern matches, then terms that give the matched entities away.

Base detectors find emails, IP addresses, cards and phone numbers. Each distinct match is a
protected entity. Corpus co-occurrence then estimates how strongly the words of a document reveal
the entities that it names: a term t is disclosing for an entity e when

    PMI(t; e) = log2( N n(t,e) / (n(t) n(e)) ) >= IC(e) / alpha,   IC(e) = log2(N / n(e)),

with N all documents, n() the documents that hold a term, an entity or both, wherever these stand, and
n(t,e) and n(e) of at least `support`. A term is a word of three letters or more once signs around it
are off, in lower case. A document that names e has every occurrence of e's disclosing terms marked;
`sanitise` generalises base matches to their kind and disclosing terms to <TERM>.

Everything is built-in expressions. Offsets are code points. Counts cover the whole corpus and are
aggregated before the shuffle. As n(t,e) <= n(e), only terms with n(t) <= n(e) (N / n(e))^(1 - 1/alpha)
can disclose e; common terms are left out of the pairs by that bound, which is exact. Entities,
terms and pairs in more than one document of SHARE are joined by broadcast: there are at most SHARE
times as many as a mean document holds, whatever the corpus size. Others are joined by exchange, where
no key has more than one in SHARE of the documents. Entities that the same documents name are one in the
pairs, so a page that lists thousands of addresses makes one entity of those that only it and its copies hold.

Edge cases: a null text is empty; texts without matches give zero counts and the digest of the empty
string; ties (a PMI that equals the threshold) count as disclosing; repeated rows and exact copies
each count as documents; rows that share a doc_id but not a text, null ids too, are documents of
their own, as marks go by (doc_id, hash of the text); very long texts are taken whole, their words
being rows of an exchange; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.lineage import cut
from tidegrid.llm.text import body

KINDS = ("email", "ip", "card", "phone")
_OWN = r"[A-Za-z0-9._%+-]"
# Possessive runs and a start only at the head of a run (or where the last match ended) keep every
# pattern linear; the matches are those of the plain patterns.
PATTERNS = {
    "email": rf"(?:(?<!{_OWN})|\G){_OWN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

ALPHA, SUPPORT = 1.25, 2
#: What is held by more than one document of so many is joined by broadcast.
SHARE = 1000
_WHITE = r"\x20\x09-\x0D"
_AROUND = rf"[^\p{{L}}{_WHITE}]*+"
_CORE = r"(\p{L}[\p{L}\p{M}'’-]+\p{L})"
#: A term within a text, and a term that is all of a word.
TERM, WHOLE = rf"(?<![^{_WHITE}]){_AROUND}{_CORE}{_AROUND}(?![^{_WHITE}])", rf"^{_AROUND}{_CORE}{_AROUND}$"


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
    return F.when((n >= 16) & (n <= 19), total % 10 == 0).otherwise(False)


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: it is the variable of a lambda over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element all up to it joined. In blocks of the root of their number, so that n elements take n^1.5 steps and no array is copied in a step."""

    def within(a: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1), lambda k: F.slice(a, k * size + 1, size))

    def joined(a: Column) -> Column:
        return F.aggregate(a, zero, join)

    def laid(blocks: Column) -> Column:
        def after(sums: Column) -> Column:
            block = lambda b, k: _let(joined(F.slice(sums, F.lit(1), k)), lambda before: F.transform(b, lambda x, i: join(before, joined(F.slice(b, F.lit(1), i + 1)))))
            return F.flatten(F.transform(blocks, block))

        return _let(F.transform(blocks, joined), after)

    return _let(values, lambda a: F.when(F.size(a) > 0, _let(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), lambda size: _let(within(a, size), laid))).otherwise(a))


def _spans(kind: str, text: str) -> Column:
    """The spans (kind, start, end, value) of a kind, in order."""
    # The pieces between matches; there is one more of them than of matches.
    pairs = F.zip_with(F.split(text, PATTERNS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda gap, m: F.struct((F.length(gap) + F.length(m)).alias("step"), F.length(m).alias("len"), m.alias("value")))

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: x["step"]), F.lit(0), lambda x, y: x + y)
        return F.zip_with(found, ends, lambda x, e: F.struct(F.lit(kind).alias("kind"), (e - x["len"]).alias("s"), e.alias("e"), x["value"].alias("value")))

    return F.filter(_let(F.filter(pairs, lambda x: x["value"].isNotNull()), placed), lambda s: _holds(kind, s["value"]))


#: What a text must hold for a kind to be searched at all; a card is a run of 16 digits at least.
_MARK = {"email": "@", "ip": ".", "phone": "+"}
_RUN = r"[0-9](?:[\x20-]?[0-9]){15}"
SPANS = "array<struct<kind:string,s:int,e:int,value:string>>"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _p_key (of the row's id and text), _p_text and _p_base, the base spans by kind and start."""
    key = F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(text).cast("string"))
    out = docs.select(F.col(doc_id).alias("doc_id"), key.alias("_p_key"), body(text).alias("_p_text"))
    none = F.array().cast(SPANS)
    each = []
    for kind in KINDS:
        worth = F.contains("_p_text", F.lit(_MARK[kind])) if kind in _MARK else F.col("_p_text").rlike(_RUN)
        each.append(F.when(worth, _spans(kind, "_p_text")).otherwise(none))
    return out.select("doc_id", "_p_key", "_p_text", F.concat(*each).alias("_p_base"))


def distinct_terms(text: str) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), " ")), " ")), "")


def _joined_counts(rows: DataFrame, counts: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with counts on keys of which some may be very frequent."""
    often = F.broadcast(counts.where(F.col(count) > total / SHARE))
    seldom = counts.where(F.col(count) <= total / SHARE)
    return rows.join(often, on).unionByName(rows.join(F.broadcast(counts.where(F.col(count) > total / SHARE).select(*on)), on, "left_anti").join(seldom, on))


class Disclosure:
    """Pairs of entities and disclosing terms, and where these terms stand."""

    def __init__(self, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, doc_id: str = "doc_id", text: str = "text") -> None:
        self.total, self.alpha, self.support = docs.count(), alpha, support
        named = F.array_distinct(F.transform("_p_base", lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))
        #: Documents that name an entity, with their texts: read from the shared folder from here on.
        naming = cut(find(docs, doc_id, text).where(F.size("_p_base") > 0).select("_p_key", "_p_text", named.alias("_p_named")))
        each = naming.select("_p_key", F.explode("_p_named").alias("name"))
        # What a term reveals of an entity hangs on the documents that name it, so entities of the same documents are
        # one: an entity is known by their number and a hash of their set (sums of three hashes, in any order).
        marks = [F.sum(F.shiftrightunsigned(F.xxhash64("_p_key", F.lit(k)), 33)).cast("string") for k in range(3)]
        #: Names of entities with support, their documents' number and the entity that stands for them.
        self.names = cut(each.groupBy("name").agg(F.count("*").alias("n_e"), F.concat_ws(":", F.count("*").cast("string"), *marks).alias("entity")).where(F.col("n_e") >= support))
        known = _joined_counts(each.distinct(), self.names, ["name"], "n_e", self.total)
        of = known.groupBy("_p_key").agg(F.collect_set(F.struct("entity", "n_e")).alias("_p_of"))
        #: Documents with the entities of support that they name.
        self.naming = cut(naming.drop("_p_named").join(of, "_p_key"))
        self.terms = docs.select(F.explode(distinct_terms_of(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)

    def _floor(self, n_e: Column) -> Column:
        """The share of a term's documents that must name an entity of n_e documents."""
        return F.pow(n_e / F.lit(float(max(1, self.total))), F.lit(1 - 1 / self.alpha))

    def pairs_by_document(self) -> DataFrame:
        """_p_key, entity, n_e, term, and n_t where the term is a common one; terms too common to disclose the entity are left out."""
        often = F.broadcast(self.terms.where(F.col("n_t") > self.total / SHARE))
        each = self.naming.select("_p_key", "_p_of", F.explode(distinct_terms("_p_text")).alias("term")).join(often, "term", "left")
        worth = F.filter("_p_of", lambda e: F.col("n_t").isNull() | (F.col("n_t") * self._floor(e["n_e"]) <= e["n_e"] * (1 + 1e-9)))
        return each.select("_p_key", "term", "n_t", F.explode(worth).alias("e")).select("_p_key", "e.entity", "e.n_e", "term", "n_t")

    def pairs(self) -> DataFrame:
        """entity, term, n_te of all pairs over the disclosure threshold; `names` has the entities' names."""
        both = self.pairs_by_document().groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t")).where(F.col("n_te") >= self.support)
        seldom = self.terms.where(F.col("n_t") <= self.total / SHARE)
        counted = both.where("n_t IS NOT NULL").unionByName(both.where("n_t IS NULL").drop("n_t").join(seldom, "term"))
        pmi = F.log2(F.lit(float(self.total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
        return counted.where(pmi >= F.log2(F.lit(float(self.total)) / F.col("n_e")) / self.alpha - 1e-12).select("entity", "term", "n_te")

    def marks(self) -> DataFrame:
        """_p_key and _p_terms: the disclosing terms of a document as spans of the kind term."""
        found = cut(self.pairs())
        reveal = _joined_counts(self.pairs_by_document().select("_p_key", "entity", "term"), found, ["entity", "term"], "n_te", self.total).select("_p_key", "term").distinct()
        texts = self.naming.groupBy("_p_key").agg(F.first("_p_text").alias("_p_text"))
        words = texts.select("_p_key", F.posexplode(F.split("_p_text", rf"[{_WHITE}]")).alias("i", "word"))
        before = Window.partitionBy("_p_key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
        placed = words.withColumn("at", start).withColumn("core", F.regexp_extract("word", WHOLE, 1)).where("core <> ''")
        lead = F.length(F.regexp_extract("word", r"^[^\p{L}]*+", 0))
        s = (F.col("at") + lead).cast("int")
        spans = placed.select("_p_key", F.lower("core").alias("term"), s.alias("s"), (s + F.length("core")).alias("e")).join(reveal, ["_p_key", "term"])
        return spans.groupBy("_p_key").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "s", "e", F.col("term").alias("value")))).alias("_p_terms"))


def distinct_terms_of(text: str) -> Column:
    """Of a column that may be null."""
    return F.coalesce(distinct_terms(text), F.array().cast("array<string>"))


def marked(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _p_text, _p_base and _p_terms for each row."""
    marks = Disclosure(docs, alpha, support, doc_id, text).marks()
    none = F.array().cast("array<struct<kind:string,s:int,e:int,value:string>>")
    return find(docs, doc_id, text).join(marks, "_p_key", "left").select("doc_id", "_p_text", "_p_base", F.coalesce("_p_terms", none).alias("_p_terms"))


def _islands() -> Column:
    """Spans, or runs of spans that overlap, with the kind of the first of them, in order."""
    spans = F.array_sort(F.transform(F.concat("_p_base", "_p_terms"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def cut_up(all_: Column) -> Column:
        def by_ends(ends: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["s"] >= F.get(ends, i - 1)))
            upto = lambda firsts, k: F.get(ends, F.coalesce(F.get(firsts, k + 1), F.size(all_)) - 1)
            return _let(first, lambda firsts: F.transform(firsts, lambda i, k: F.struct(F.get(all_, i)["s"].alias("s"), upto(firsts, k).alias("e"), F.get(all_, i)["kind"].alias("kind"))))

        return _let(_running(F.transform(all_, lambda x: x["e"]), F.lit(0), lambda x, y: F.greatest(x, y)), by_ends)

    return _let(spans, cut_up)


#: Code points of the blocks that a text is cut into before many pieces are taken from it.
_PAGE = 4096


def _pieces(text: Column, islands: Column) -> Column:
    """The text with each island written as its kind. A piece is taken from the few blocks that it lies in, not counted off from the text's beginning."""
    pages = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _PAGE).cast("int")), lambda k: text.substr(k * _PAGE + 1, F.lit(_PAGE)))

    def written(both: Column) -> Column:
        page, held, size = both["pages"], both["islands"], both["size"]
        whole = lambda x: F.floor(x / _PAGE).cast("int")
        piece = lambda a, b: F.array_join(F.slice(page, whole(a) + 1, whole(b) - whole(a) + 1), "").substr(a % _PAGE + 1, b - a)
        end = lambda i: F.coalesce(F.get(held, i)["e"], F.lit(0))
        parts = F.transform(held, lambda x, i: F.concat(piece(end(i - 1), x["s"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), piece(end(F.size(held) - 1), size))

    return _let(F.struct(pages.alias("pages"), islands.alias("islands"), F.length(text).alias("size")), written)


def _sanitised(found: DataFrame) -> DataFrame:
    """Adds _p_clean, the text with each island written as its kind."""
    some = F.size("_p_base") + F.size("_p_terms") > 0
    return found.withColumn("_p_clean", F.when(some, _pieces(F.col("_p_text"), _islands())).otherwise(F.col("_p_text")))


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id and the text with base matches generalised to their kind and disclosing terms to <TERM>."""
    return _sanitised(marked(docs, alpha, support)).select("doc_id", F.col("_p_clean").alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def report(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """One row for each document: counts by kind, the digest of the base spans, all spans, the digest of the sanitised text."""
    out = _sanitised(marked(docs, alpha, support))
    count = lambda k: F.size(F.filter("_p_base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("_p_base")), 256).alias("base_sha256"),
        _joined(F.concat("_p_base", "_p_terms")).alias("spans"),
        F.sha2("_p_clean", 256).alias("sanitised_sha256"),
    )
