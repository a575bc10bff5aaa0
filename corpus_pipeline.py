"""The corpus pipeline: each stage works on all that the one before has kept, and its decisions take effect.

Stages hand on the columns of ``documents``; the last one returns packed pieces. Stages judge each row where it
stands, so rows without an id stay if they pass; null texts go with the language. Of repeated rows, of equal id and text, one stays;
rows of one id with different texts are judged by their texts, and stand or fall together among near-duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import decontaminate, language_id, line_dedup, packing, simhash
from kgloom.llm.common import fold_of, scan, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of ids, sent to all executors if it has ``most`` rows at most."""
    return F.broadcast(ids) if ids.count() <= most else ids


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a language is given; null texts, those without a letter, and doubtful ones (score under 0.3) go."""
    return language_id.accepted(language_id.identify(docs, docs.where(fold_of("doc_id", 5) != 0), COLUMNS)).select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, or pieces of long ones, that come earlier, equal or but for one word."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    found = written(simhash.near_duplicates(docs))
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct())
    rest = docs.join(small(gone), "doc_id", "left_anti")
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest.select(COLUMNS)
    once = rest.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(small(again), "doc_id", "left_anti").unionByName(once).select(COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    found = decontaminate.judged(decontaminate.contamination(docs, scan(spark, sf_dir, "benchmark"), COLUMNS))
    return found.where("not contaminated").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    # smaller batches and word tables, as workers still hold what earlier stages left in memory
    return packing.pack_documents(docs, batch_bytes=2 << 20, cached_words=1 << 17)


STAGES = [
    ("language_id", by_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]

#: SQL can't express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
