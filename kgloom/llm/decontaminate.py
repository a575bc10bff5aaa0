"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark items.

Every window of 13 words of an item holds, whole, one of the grams of 7 words that stand end to end from the item's start. Only these
grams are patterns, so the automaton grows with the benchmark's text and not with its windows. A gram that is found is
followed to both sides, word by word, for as long as text and item agree; what reaches the length of a window is hit.
Each text is normalised once and scanned once; hits are mapped back to words and to code points of the original. Nulls and empty texts have no words and no hits; items without a word or an id are
ignored; equal windows of several items count for each; repeated document rows are judged each on its own;
an empty benchmark hits nothing, and an empty table gives an empty result. Very long texts are scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import annotate, doc_text, scan, written

#: Bytes to what they count as: A-Z in lower case, other ASCII but digits and letters as a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "n_words long, n_hit long, items array<string>, runs array<struct<a:long,b:long,start:long,end:long>>"
#: First and last word of a run of hit words, and its place in code points.
RUN = pa.list_(pa.struct([(k, pa.int64()) for k in ("a", "b", "start", "end")]))


def item_texts(rows: list[tuple[str, str]]) -> dict[bytes, list[str]]:
    """The items' words, joined by spaces, with the ids of the items that have them."""
    found: dict[bytes, set[str]] = {}
    for item, text in rows:
        if words := (text or "").encode().translate(TABLE).split():
            found.setdefault(b" ".join(words), set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


def _automaton(texts: list[bytes], window: int):
    """Patterns of whole words; each has its number of words and where it stands: number of the text and first word (-1: the whole text)."""
    import ahocorasick

    places: dict[str, tuple[int, list[tuple[int, int]]]] = {}
    gram = (window + 1) // 2
    for k, text in enumerate(texts):
        words = text.decode("latin-1").split(" ")
        short = len(words) < window
        for p in [0] if short else range(0, len(words) - gram + 1, gram):
            some = words if short else words[p : p + gram]
            places.setdefault(f" {' '.join(some)} ", (len(some), []))[1].append((k, -1 if short else p))
    if not places:
        return None
    made = ahocorasick.Automaton()
    for pattern, value in places.items():
        made.add_word(pattern, value)
    made.make_automaton()
    return made


def _followed(words: list[bytes], item: list[bytes], start: int, end: int, p: int) -> tuple[int, int]:
    """First and last word (exclusive) of what agrees with ``item`` around words ``start`` to ``end``, which stand there from ``p``."""
    q = p + end - start
    while start and p and words[start - 1] == item[p - 1]:
        start, p = start - 1, p - 1
    while end < len(words) and q < len(item) and words[end] == item[q]:
        end, q = end + 1, q + 1
    return start, end


def _runs(hit) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scanner(items, window: int):
    """What ``annotate`` asks for: hits of one part of the benchmark; ``items``: its broadcast texts."""

    def prepare():
        import numpy as np

        texts_of, ids_of = list(items.value), list(items.value.values())
        made = _automaton(texts_of, window)

        def compute(texts):
            n_words, n_hit, items, runs = [], [], [], []
            for t in texts:
                w = (t or b"").translate(TABLE).split()
                joined = b" " + b" ".join(w) + b" "
                found = list(made.iter(joined.decode("latin-1"))) if w and made else []
                hit, of = np.zeros(len(w) if found else 0, bool), set()
                if found:
                    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                    ends = np.searchsorted(spaces, [e for e, _ in found])
                    reached: dict[tuple[int, int], int] = {}  # by text and by how far it is moved against the document
                    split: dict[int, list[bytes]] = {}
                    for end, (_, (n, places)) in zip(ends.tolist(), found, strict=True):
                        for k, p in places:
                            a, b = end - n, end
                            if p >= 0:
                                if reached.get((k, a - p), 0) >= end:
                                    continue
                                if k not in split:
                                    split[k] = texts_of[k].split(b" ")
                                moved = k, a - p
                                a, b = _followed(w, split[k], a, b, p)
                                reached[moved] = b
                                if b - a < window:
                                    continue
                            hit[a:b] = True
                            of.update(ids_of[k])
                at = [m.span() for m in WORD.finditer(t.decode())] if hit.any() else []
                n_words.append(len(w))
                n_hit.append(int(hit.sum()))
                items.append(sorted(of))
                runs.append([{"a": a, "b": b, "start": at[a][0], "end": at[b][1]} for a, b in _runs(hit)])
            return pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, RUN)

        return compute

    return prepare


def _merged(runs: Column) -> Column:
    """Runs of hit words, those that meet or overlap made one."""
    none = F.array().cast("array<struct<a:long,b:long,start:long,end:long>>")

    def add(held: Column, x: Column) -> Column:
        last = F.get(held, F.size(held) - 1)
        both = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(last["b"] + 1 >= x["a"], F.concat(F.slice(held, 1, F.size(held) - 1), F.array(both))).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(F.array_sort(runs), none, add)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = 13, shard_bytes: int = 4 << 20) -> DataFrame:
    """Per document row, beside the columns ``keep`` (doc_id): words, words within benchmark windows, the items, hit spans in code points.

    The benchmark is measured first; one larger than ``shard_bytes`` of text is cut by a hash of the item
    into parts of about that size. The texts are then written once and scanned part by part, each part's automaton
    built once in a task, and the parts' hits are merged by row.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-size // shard_bytes))
    docs, keep = (docs, keep) if keep else (doc_text(docs), ["doc_id"])

    def scanned(texts: DataFrame, kept: list[str], k: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        return annotate(texts, kept, HITS, scanner(spark.sparkContext.broadcast(item_texts([tuple(r) for r in part.collect()])), window))

    if n == 1:
        found = scanned(docs, keep, 0)
    else:
        texts = written(docs.select(*dict.fromkeys([*keep, "text"]), F.monotonically_increasing_id().alias("_row")))
        first = written(scanned(texts, [*keep, "_row"], 0))
        hits = first.where("n_hit > 0").select("_row", "items", "runs")
        for k in range(1, n):
            hits = hits.union(written(scanned(texts, ["_row"], k).where("n_hit > 0").select("_row", "items", "runs")))
        flat = lambda c: F.flatten(F.collect_list(c))
        hits = hits.groupBy("_row").agg(F.array_sort(F.array_distinct(flat("items"))).alias("all_items"), _merged(flat("runs")).alias("all_runs"))
        n_hit = F.aggregate("all_runs", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"] + 1)
        found = first.join(hits, "_row", "left").select(
            *keep, "n_words", F.coalesce(n_hit, "n_hit").alias("n_hit"), F.coalesce("all_items", "items").alias("items"), F.coalesce("all_runs", "runs").alias("runs")
        )
    return found.withColumn("spans", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))).drop("runs")


def judged(hits: DataFrame) -> DataFrame:
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(contamination(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
