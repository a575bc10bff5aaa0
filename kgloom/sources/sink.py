"""Graph tables that batches are merged into: Parquet, partitioned by a hash of the key.

A batch rewrites only the partitions that its keys fall into, by dynamic partition overwrite. What they become is first written
beside the table and marked as whole; then it is published. A batch that comes again, after a crash or a retry of the stream, publishes
what is marked, or skips the partitions that bear its number already; so it counts once, wherever it was cut off.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from kgloom.operators.components import written

PARTITION, BATCH = "bucket", "batch"


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or an empty one where there is none yet, with the columns of its partition and its last batch."""
    whole = StructType([*schema.fields, StructField(BATCH, LongType()), StructField(PARTITION, IntegerType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def publish(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)


def upsert(path: str, batch: DataFrame, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], number: int, partitions: int = 64) -> DataFrame:
    """Merges ``batch`` into the table at ``path`` and returns the table without its own two columns.

    ``merge`` gives the rows that stored and new ones become; it sees only partitions with keys of the batch. ``number`` grows from batch to
    batch; a lower one than a partition has seen changes nothing there. ``partitions`` is fixed when the table is made.
    """
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64(*key), F.lit(partitions)).cast("int")
    held = stored(spark, path, batch.schema)
    staged, mark = f"{path}-staged-{number % 2}", f"{path}-staged-{number % 2}-mark"
    whole = stored(spark, mark, StructType([StructField("number", LongType())])).where(F.col("number") == number)
    last = held.groupBy(PARTITION).agg(F.max(BATCH).alias("last"))
    if whole.isEmpty():
        new = written(batch.withColumn(PARTITION, place).join(F.broadcast(last.where(F.col("last") >= number).select(PARTITION)), PARTITION, "left_anti"))
        touched = [r[0] for r in new.select(PARTITION).distinct().collect()]  # at most ``partitions``
        old = held.where(F.col(PARTITION).isin(touched)).select(batch.columns)
        rows = merge(old, new.select(batch.columns)).select(batch.columns).withColumn(BATCH, F.lit(number).cast("long")).withColumn(PARTITION, place)
        rows.repartition(PARTITION).write.mode("overwrite").parquet(staged)
        spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(number).cast("long").alias(BATCH), F.lit(0).alias(PARTITION)).write.mode("overwrite").parquet(mark)
    later = F.broadcast(last.where(F.col("last") > number).select(PARTITION))
    publish(stored(spark, staged, batch.schema).join(later, PARTITION, "left_anti"), path)
    return stored(spark, path, batch.schema).select(batch.columns)
