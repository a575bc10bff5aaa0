"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgloom.operators.components import shared_dir, written  # noqa: F401

#: What separates words: space and the ASCII controls from tab to carriage return.
WHITE = " \t\n\x0b\f\r"


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def give_back() -> None:
    """Memory that this process has freed goes back to the system, as workers outlive their tasks."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps the holes in its heap otherwise
    if trim:
        trim(0)


def batches(parts: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches of ``doc_id, text`` cut to about ``most_bytes`` of text, and the texts as UTF-8 (null: None).

    What earlier tasks of the worker have freed goes back to the system first.
    """
    give_back()
    for part in parts:
        texts = part.column("text").cast(pa.binary())
        start, held = 0, 0
        for i in range(part.num_rows):
            held += len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if held >= most_bytes or i == part.num_rows - 1:
                yield part.slice(start, i + 1 - start), texts[start : i + 1].to_pylist()
                start, held = i + 1, 0


def annotate(docs: DataFrame, keep: list[str], schema: str, prepare: Callable[[], Callable], most_bytes: int = 8 << 20) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those of ``schema``, computed from ``text`` within one pass.

    ``prepare`` is called once in each task; what it gives is called with the texts of a batch (UTF-8, null: None) and
    returns one array for each column of ``schema``. A kept column of the same name is replaced. Where texts are kept, only
    what is computed comes back from Python.
    """
    new = StructType.fromDDL(schema)
    kept = [c for c in dict.fromkeys(keep) if c not in new.names]
    if "text" in kept:

        def told(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            compute = prepare()
            for part in parts:
                for _, texts in batches(iter([pa.RecordBatch.from_arrays([part], names=["text"])]), most_bytes):
                    yield pa.StructArray.from_arrays(compute(texts), names=new.names)

        name = f"told_{uuid.uuid4().hex}"
        found = F.arrow_udf(told, new).asNondeterministic()
        return docs.select(*kept, found(F.col("text").cast("string")).alias(name)).select(*kept, f"{name}.*")
    read = docs.select(*kept, *(["text"] if "text" not in kept else []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for part, texts in batches(parts, most_bytes):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *compute(texts)], names=[*kept, *new.names])

    return read.mapInArrow(run, StructType([*(read.schema[c] for c in kept), *new.fields]))


def doc_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, whatever else ``docs`` has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
