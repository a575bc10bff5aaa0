"""Quality rules: a threshold table compiled into one projection of built-in functions.

Nulls and empty texts have no words and fail the base rule. Repeated rows are judged alike, each on
its own; an empty table gives an empty result; other columns of the input are ignored; very long texts are counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import WHITE, bind, doc_text, scan

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the be to of and that have with for is on it as are this in a not from by at or was an",
    "der die das und ist nicht ein eine zu mit auf für den von im dem des sich als auch",
    "el la los las de que y en un una por con no para es se del al lo como",
    "le la les de des et un une du est que qui dans pour pas sur au en ne avec",
)

#: metric, least, greatest. A document is kept if every metric lies within its bounds.
RULES = (
    ("n_words", 50, 100_000_000),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", 0.0, 0.10),
    ("letter_ratio", 0.60, 1.0),
    ("stop_word_ratio", 0.01, 1.0),
    ("dup_line_ratio", 0.0, 0.60),
    ("ellipsis_line_ratio", 0.0, 0.30),
    ("repeat_word_ratio", 0.0, 0.50),
)

SYMBOLS = r"[#*$%&|<>]"
#: What may stand around a stop word.
MARKS = ".,;:!?\"'()[]{}*#$%&|<>"
NOT_BLANK = r"[^ \t-\r]"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words within three-word windows that occur at least twice.

    Windows are sorted as numbers of 32 hash bits and the position; only those with an equal neighbour
    are then compared as strings, so the count is exact.
    """
    high = F.lit(-(1 << 32))
    keys = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
    )
    same = lambda x, y: F.coalesce(F.shiftright(x, 32) == F.shiftright(y, 32), F.lit(False))
    likely = bind(F.sort_array(keys), lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))))
    windows = F.transform(
        F.transform(likely, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    equal = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    repeated = bind(F.sort_array(windows), lambda s: F.filter(s, lambda x, j: equal(x, F.get(s, j - 1)) | equal(x, F.get(s, j + 1))))
    return bind(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
        ),
    )


def metrics(text: Column) -> Column:
    """A struct with the counts of one text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    stops = sorted({w for x in STOP_WORDS for w in x.split()})
    lines = bind(
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NOT_BLANK)),
        lambda k: F.struct(
            F.size(k).alias("n_lines"),
            (F.size(k) - F.size(F.array_distinct(k))).alias("n_dup_lines"),
            F.size(F.filter(k, lambda x: F.btrim(x, F.lit(WHITE)).rlike(r"(\.\.\.|…)$"))).alias("n_ellipsis"),
        ),
    )
    return bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(F.array_join(w, ""), r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _repeat_words(w, F.size(w)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(MARKS))).isin(stops))).alias("n_stop"),
            F.length(F.regexp_replace(F.array_join(w, ""), r"\P{L}+", "")).cast("long").alias("n_letters"),
            lines.alias("lines"),
        ),
    )


def apply_rules(docs: DataFrame, rules: tuple[tuple[str, float, float], ...] = RULES) -> DataFrame:
    """``doc_id``, counts, ratios, ``base_failed``, ``failed`` (names of broken rules) and ``kept``."""
    counted = doc_text(docs).select("doc_id", metrics(F.col("text")).alias("m")).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.n_repeat_words", "m.n_stop", "m.n_letters", "m.lines.n_lines", "m.lines.n_ellipsis"
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "letter_ratio": per("n_letters", "word_chars"),
        "stop_word_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }
    broken = F.filter(F.array(*[F.when(~values[k].between(lo, hi), F.lit(k)) for k, lo, hi in rules]), lambda x: x.isNotNull())
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base_failed.alias("base_failed"),
        F.array_join(broken, ",").alias("failed_rules"),
        (~base_failed & (F.size(broken) == 0)).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(scan(spark, sf_dir, "documents"))
