"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing.

    ``name``: the table of that name is written anew, so rounds can take turns with two tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, hot: int | None = None) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, where many rows of ``left`` may have the same.

    ``sizes``: ``key`` and ``n``, its number of rows in ``left``. Keys of more than ``hot`` rows (1,000, and a 100,000th of the
    left rows) are 100,000 at most, so their rows of ``right`` are sent to where the left ones lie; the rest meet by shuffle.
    """
    if hot is None:
        hot = max(1_000, (sizes.agg(F.sum("n")).head()[0] or 0) // 100_000)
    keys = F.broadcast(sizes.where(F.col("n") > hot).select(key))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    return left.join(few, key).unionByName(left.join(keys, key, "left_anti").join(right, key))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable over ``a, b`` rows, for every node with an edge.

    Each round a node takes the least label among its own, its neighbours' and its label's label (pointer
    jumping), so chains halve. Rounds take turns with two tables in the shared folder; nodes of a very
    large component don't meet at their common label. Null ends are ignored; loops make single nodes; more
    rounds than ``most_rounds`` raise.
    """
    run = uuid.uuid4().hex
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    both = written(e.union(e.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{run}-odd")
    for i in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = written(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("label")), f"{run}-near")
        sizes = seen.groupBy("label").agg(F.count("*").alias("n"))
        roots = labels.select(F.col("node").alias("label"), F.col("component").alias("root")).join(sizes.select("label"), "label", "left_semi")
        new = written(spread_join(seen, roots, "label", sizes).select("node", "old", F.least("label", "root").alias("component")), f"{run}-{i % 2}")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
