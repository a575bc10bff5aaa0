"""Large benchmarks, rows without ids and texts beyond a batch's bytes."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from kgloom.llm import decontaminate, licenses, packing


def test_grams_find_every_window(spark):
    """Windows at all distances from the grams' places, cut, repeated and side by side."""
    r = random.Random(5)
    items = [[r.choice("abcdefghijk") * r.randint(1, 2) for _ in range(n)] for n in (1, 5, 12, 13, 14, 19, 20, 21, 40, 41)] + [["x"] * 30, list("abcab" * 8)]
    bench = [(f"i{k}", " ".join(w)) for k, w in enumerate(items)] + [("same", " ".join(items[8])), (None, "a b c"), ("none", None), ("blank", " .. ")]
    docs = []
    for n in range(160):
        w = []
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(items))
            a = r.randint(0, len(items[k]))
            w += [r.choice("abcdefghijk") for _ in range(r.randint(0, 6))] + items[k][a : a + r.randint(0, 30)]
        docs.append((n, ", ".join(w).upper()))
    docs += [(200, "x " * 14), (201, "x " * 12), (None, " ".join(items[9])), (202, None)]
    windows = {}
    for i, t in bench:
        w = (t or "").replace(".", " ").split()
        for p in range(max(1, len(w) - 12) if w and i else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(i)
    expected = []
    for d, t in docs:
        w = (t or "").lower().replace(",", " ").split()
        hit, of = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    of |= windows[g]
        expected.append((d, len(w), len(hit), sorted(of)))
    for shard in (4 << 20, 60):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string"), shard_bytes=shard).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got), key=str) == sorted(expected, key=str)


def test_memory_of_an_automaton_grows_with_the_text():
    """A part of the benchmark at its bound, of random words, stays under 600 MB in a process of its own."""
    code = """
import random, resource
from kgloom.llm import decontaminate as d
r = random.Random(1)
w = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(50_000)]
texts = [" ".join(r.choice(w) for _ in range(200)).encode() for _ in range((4 << 20) // 1400)]
made = d._automaton(texts, 13)
print(len(made), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    patterns, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert patterns > 80_000 and mb < 600


def measured(code):
    """Numbers that ``code`` prints, run in a process of its own; ``held()``: MB that the process holds now, ``most()``: at most so far."""
    helpers = """
import re, resource
held = lambda: sum(map(int, re.findall(r"\\nAnonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
"""
    return [int(x) for x in subprocess.run([sys.executable, "-c", helpers + code], capture_output=True, text=True, check=True).stdout.split()]


def test_workers_give_back_what_tasks_have_freed():
    """Holes that a task leaves in the heap are not held while the next one works."""
    before, after = measured("""
import pyarrow as pa
from kgloom.llm.common import batches
made = [bytes(4000) for _ in range(30_000)]
made = made[-1]  # lies on top of the heap
before = held()
texts = next(batches(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})])))
print(before, held())
""")
    assert before - after > 60


def test_memory_of_words_that_take_the_whole_tokenizer():
    """60,000 of them in one batch, with the tokenizer itself."""
    start, end = measured("""
import random
import numpy, public_tokenizers, tokenizers
from kgloom.llm.packing import WordCoder
r = random.Random(1)
words = ["".join(r.choice("abcdefgh1234-_:") for _ in range(12)) for _ in range(60_000)]
spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
start = most()
WordCoder(spec, 1 << 17)(words)
print(start, most())
""")
    assert end - start < 95


def test_rows_without_ids_are_dealt_evenly(spark):
    n = 40_000
    pieces = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    sizes = [r["n"] for r in packing.pack(pieces).groupBy(F.shiftright("sequence_id", 32).alias("shard")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) == 3 and max(sizes) < 1.1 * n / 3


@pytest.mark.parametrize("size", [9 << 20])
def test_texts_beyond_a_batch(spark, size):
    text = ("some words of a very long text " * (size // 31 + 1))[:size]
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    item = "of a very long text some words of a very long text some words"
    got = decontaminate.contamination(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()
    n = len(text.split())
    assert {(r.doc_id, r.n_words) for r in got} == {(1, n), (2, 1), (3, n)} and all(r.n_hit > 0.99 * n for r in got if r.doc_id != 2)
    assert {(r.doc_id) for r in got if r.n_hit == 0} == {2}


def test_templates_are_cut_like_texts(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy."
    docs = spark.createDataFrame([(1, text), (2, text.upper()), (3, "Nothing of that kind."), (None, None)], "doc_id long, text string")
    templates = spark.createDataFrame([("grant", text), ("blank", " .. "), ("none", None)], "label string, text string")
    got = {r.doc_id: r.found for r in licenses.find_licenses(docs, templates).collect()}
    assert [x.label for x in got[1]] == [x.label for x in got[2]] == ["grant"] and not got[3] and not got[None]
