"""Rule-based quality filter: a table of thresholds compiled into one projection.

Every measure is a built-in expression, so the whole operator is a single scan without a shuffle.

Edge cases: a null text counts as empty; an empty text has zero words and fails; rows with equal
ids, repeated ones too, are judged one by one; ties: a measure that equals its bound passes; a very
long text is judged whole, in arrays as long as its words; an empty table gives an empty result;
other columns pass through untouched unless their names begin with _q_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.text import body, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of to and in that is was it for on with as be at by this are from an a",
    "der die das und zu den in von mit sich des auf dem ist im nicht ein eine",
    "le la les de des et en un une du que est pour dans qui par sur au",
    "el la los las de que y en un una se del por con para es no lo",
)

# Beside the usual ratios: bar_ratio finds tables and menus flattened to text, shout_ratio advertising
# (words that end in "!!"), stutter_ratio generated loops of one word.
#: (measure, least, most): a text fails if any measure lies outside its bounds. Words count, ratios are a word or a line.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("repeat_ratio", None, 0.30),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.25),
    ("stop_ratio", 0.05, None),
    ("upper_ratio", None, 0.40),
    ("bar_ratio", None, 0.25),
    ("shout_ratio", None, 0.25),
    ("dup_line_ratio", None, 0.60),
    ("stutter_ratio", None, 0.30),
)

WINDOW = 8


def _stop_words() -> list[str]:
    return sorted({w for line in STOP_WORDS for w in line.split()})


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _q_ columns: words, characters, symbols, repeated lines and repeated windows of eight words."""
    n = F.size("_q_words")
    # A window's hash is built from halves: pairs, then fours, then eights.
    def double(name: str, step: int) -> Column:
        return F.transform(name, lambda x, i: F.xxhash64(x, F.get(F.col(name), i + F.lit(step))))

    out = (
        docs.withColumn("_q_text", body(text))
        .withColumn("_q_words", words(F.col("_q_text")))
        .withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_q_h1", F.transform("_q_words", lambda w: F.xxhash64(w)))
        .withColumn("_q_h2", double("_q_h1", 1))
        .withColumn("_q_h4", double("_q_h2", 2))
        .withColumn("_q_h8", F.slice(double("_q_h4", 4), 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
        .withColumn(
            "_q_sorted",
            F.when(
                F.size(F.array_distinct("_q_h8")) < F.size("_q_h8"),
                F.sort_array(F.transform("_q_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn(
            "_q_twice",
            F.sort_array(
                F.transform(
                    F.filter(
                        "_q_sorted",
                        lambda s, k: F.coalesce(s["h"] == F.get(F.col("_q_sorted"), k - 1)["h"], F.lit(False))
                        | F.coalesce(s["h"] == F.get(F.col("_q_sorted"), k + 1)["h"], F.lit(False)),
                    ),
                    lambda s: s["i"],
                )
            ),
        )
    )
    covered = F.aggregate(
        F.transform("_q_twice", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q_twice"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return out.withColumns(
        {
            "_q_n_words": n.cast("bigint"),
            "_q_word_chars": F.length(F.regexp_replace("_q_text", r"[\x20\x09-\x0D]+", "")).cast("bigint"),
            "_q_n_symbols": F.length(F.regexp_replace("_q_text", r"[^#*$%&|<>]+", "")).cast("bigint"),
            "_q_n_lines": F.size("_q_lines").cast("bigint"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
            "_q_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "_q_n_stop": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(_stop_words()))).cast("bigint"),
            "_q_n_upper": F.length(F.regexp_replace("_q_text", r"[^A-Z]+", "")).cast("bigint"),
            "_q_n_bars": F.size(F.filter("_q_words", lambda w: w == "|")).cast("bigint"),
            "_q_n_stutters": F.size(F.filter("_q_words", lambda w, i: w == F.get(F.col("_q_words"), i - 1))).cast("bigint"),
            "_q_n_shouts": F.size(F.filter("_q_words", lambda w: w.endswith("!!"))).cast("bigint"),
        }
    )


def compiled(thresholds=THRESHOLDS) -> Column:
    """True for a row of measures() that is inside every bound."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("_q_n_words"), F.lit(1))
    value = {
        "n_words": F.col("_q_n_words"),
        "repeat_ratio": per_word("_q_n_repeat_words"),
        "mean_word_chars": per_word("_q_word_chars"),
        "symbol_ratio": per_word("_q_n_symbols"),
        "stop_ratio": per_word("_q_n_stop"),
        "upper_ratio": F.col("_q_n_upper") / F.greatest(F.col("_q_word_chars"), F.lit(1)),
        "bar_ratio": per_word("_q_n_bars"),
        "shout_ratio": per_word("_q_n_shouts"),
        "stutter_ratio": per_word("_q_n_stutters"),
        "dup_line_ratio": F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)),
    }
    verdict = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            verdict &= value[name] >= F.lit(least)
        if most is not None:
            verdict &= value[name] <= F.lit(most)
    return verdict


def judge(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """docs with _q_base_failed and _q_kept beside the measures; no row is lost."""
    failed = (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))
    return measures(docs, text).withColumn("_q_base_failed", failed).withColumn("_q_kept", ~failed & compiled(thresholds))


def keep_good(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows that pass, with the columns they came with.

    The optimizer would write the verdict's whole expression, arrays within arrays, into a filter
    below the projections and so work each array out again for each of its elements. A row number
    beside the verdict, which is not deterministic, keeps the filter above them.
    """
    judged = judge(docs, text, thresholds).withColumn("_q_row", F.monotonically_increasing_id())
    return judged.where(F.col("_q_kept") & (F.col("_q_row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """One row for each document with its measures and verdict."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_q_n_words").alias("n_words"),
        F.col("_q_word_chars").alias("word_chars"),
        F.col("_q_n_symbols").alias("n_symbols"),
        F.col("_q_n_dup_lines").alias("n_dup_lines"),
        F.col("_q_n_repeat_words").alias("n_repeat_words"),
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
    )
