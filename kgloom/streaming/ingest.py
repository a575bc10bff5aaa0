"""Triplet files merged into the edge table as they arrive.

Each micro-batch is an upsert under the number of the batch: only partitions with its keys are rewritten, and a replayed batch counts once. What is
first is decided by ``seq``, so the order of files doesn't matter.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.operators import canonical
from kgloom.operators.triplets import canonicalize
from kgloom.sources.sink import upsert

KEY = ["source_type", "source_id", "relationship", "destination_type", "destination_id"]


def partial_edges(t: DataFrame) -> DataFrame:
    """Edges of a batch of canonical triplets in a form that can be merged: the first description with its ``seq``, documents, and a count."""
    x = t.select(
        N.graph_type(F.col("source_type")).alias("source_type"),
        N.canonical_id(F.col("source_type"), F.col("source_node")).alias("source_id"),
        N.relation_type(F.col("relationship")).alias("relationship"),
        N.graph_type(F.col("destination_type")).alias("destination_type"),
        N.canonical_id(F.col("destination_type"), F.col("destination_node")).alias("destination_id"),
        F.when(F.col("description") != "", F.struct("seq", "description")).alias("first"),
        F.array("document_id").alias("document_ids"),
        F.lit(1).cast("long").alias("evidence_count"),
    )
    return merged(x)


def merged(x: DataFrame) -> DataFrame:
    return x.groupBy(*KEY).agg(F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("document_ids")))).alias("document_ids"), F.sum("evidence_count").alias("evidence_count"))


def partial_nodes(t: DataFrame) -> DataFrame:
    """Nodes of a batch of canonical triplets in a form that can be merged: the first name with its place, all names, and a count."""
    x = canonical.ends(t).select("entity_type", "canonical_id", F.struct((F.col("seq") * 2 + F.col("end")).alias("at"), "name").alias("first"), F.array("name").alias("names"), F.lit(1).cast("long").alias("mentions"))
    return merged_nodes(x)


def merged_nodes(x: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    return x.groupBy("entity_type", "canonical_id").agg(F.min("first").alias("first"), names.alias("names"), F.sum("mentions").alias("mentions"))


def ingest(spark: SparkSession, files: str, schema, out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Merges all triplet files (Parquet) that are there and not yet merged; returns the edge table."""
    found = []

    def step(batch: DataFrame, k: int) -> None:
        found.append(upsert(out, partial_edges(canonicalize(batch)), KEY, lambda old, new: merged(old.unionByName(new)), k))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return found[-1] if found else spark.read.parquet(out)
