"""Phrase collocation mining by stripes.

A stripe is a prefix of one or two words with an associative counter of the words that come next; the end of a piece counts as
a next word of its own, so that a stripe's sum is how often its prefix occurs. Each task fills stripes over some millions
of words before it hands them on, and stripes of one prefix are then merged element by element. From them come the
phrases (extensions), the counts of their parts (sums of prefixes) and the largest longer phrase around each (maxima).

The stripe of a common word is long, so every stripe is cut by a hash of the next word into as many parts as the corpus
asks for (the square root of its megabytes); only in-task sums of a part meet in one place. Stripes of two words are
filled only where a filter says that both pairs are frequent enough, which loses no phrase, as no part of a phrase is
rarer than the phrase.

Null texts are empty, null languages are ``und``; rows of the same text count each, whatever their ids. Texts are read
whole, ids and other columns aside. An empty table gives an empty result. Ties in score and count go by the phrase.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.bloom import bloom, holds
from kgloom.llm.common import batches, scan, written
from kgloom.operators.components import spread_join

#: What ends a piece of text.
ENDS = re.compile(rb"[.,;:!?\n-\r]+")
STRIPE = "lang string, w1 string, w2 string, part int, next array<string>, n array<long>"
#: Words of a task between two deliveries of its stripes, and different words of it.
MOST_TOKENS, MOST_WORDS = 3_000_000, 1_000_000
#: Odd numbers that mix the hashes of a pair's words.
FIRST, SECOND, LAST = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


class Numbered(dict):
    """Words by number, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = at = len(self)
        return at


def _word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    return np.array([digest(w, 42) for w in words], np.uint64)


def pair_keys(first, second, lang: bytes):
    """64-bit keys of word pairs of a language, from the hashes of the words."""
    import numpy as np

    with np.errstate(over="ignore"):
        h = first * np.uint64(FIRST) + (second ^ _word_hashes([lang])) * np.uint64(SECOND)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(LAST)
        return h ^ (h >> np.uint64(29))


def _rows(lang: str, words: pa.Array, hashes, first, second, after, counts, parts: int) -> Iterator[pa.RecordBatch]:
    """Stripes of the given triples (second: None for prefixes of one word)."""
    import numpy as np

    part = (hashes[after] % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((part, first)) if second is None else np.lexsort((part, second, first))
    part, first, after, counts = part[by], first[by], after[by], counts[by]
    new = (np.diff(part) != 0) | (np.diff(first) != 0)
    if second is not None:
        second = second[by]
        new |= np.diff(second) != 0
    at = np.concatenate(([0], np.flatnonzero(new) + 1))
    ends = np.append(at, len(part))
    for i in range(0, len(at), 20_000):
        rows = at[i : i + 20_000]
        a, b = ends[i], ends[min(i + 20_000, len(at))]
        offsets = pa.array(ends[i : i + len(rows) + 1] - a, pa.int32())
        columns = [
            pa.array([lang] * len(rows)),
            words.take(pa.array(first[rows])),
            words.take(pa.array(second[rows] if second is not None else np.zeros(len(rows), np.int64))),
            pa.array(part[rows], pa.int32()),
            pa.ListArray.from_arrays(offsets, words.take(pa.array(after[a:b]))),
            pa.ListArray.from_arrays(offsets, pa.array(counts[a:b], pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "w1", "w2", "part", "next", "n"])


def _stripes(docs: DataFrame, parts: int, frequent=None) -> DataFrame:
    """Stripes as tasks fill them: of one word, or with ``frequent`` (a filter of pairs) of two."""

    def deliver(number: Numbered, held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        listed = [b"", *list(number)[1:]]
        words, hashes, v = pa.array([w.decode() for w in listed]), _word_hashes(listed), len(listed)
        for lang, arrays in held.items():
            x = np.concatenate(arrays).astype(np.int64)
            if frequent is None:
                pairs = (x[:-1] * v + x[1:])[x[:-1] > 0]
                found, counts = np.unique(pairs, return_counts=True)
                if len(found):
                    yield from _rows(lang, words, hashes, found // v, None, found % v, counts, parts)
                continue
            ok = (x[:-1] > 0) & (x[1:] > 0)
            at = np.flatnonzero(ok)
            ok[at] = holds(frequent.value, pair_keys(hashes[x[at]], hashes[x[at + 1]], lang.encode()))
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if len(at):
                pairs, of = np.unique(x[at] * v + x[at + 1], return_inverse=True)
                found, counts = np.unique(of * v + x[at + 2], return_counts=True)
                yield from _rows(lang, words, hashes, pairs[found // v] // v, pairs[found // v] % v, found % v, counts, parts)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number, held, size = Numbered(), {}, 0
        for part, texts in batches(rows):
            for lang, t in zip(part.column("lang").to_pylist(), texts, strict=True):
                if t:
                    tokens = ENDS.sub(b" . ", t.lower()).split() + [b"."]
                    held.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
                    size += len(tokens)
                if size >= MOST_TOKENS or len(number) >= MOST_WORDS:
                    yield from deliver(number, held)
                    number, held, size = Numbered(), {}, 0
        if held:
            yield from deliver(number, held)

    return docs.mapInArrow(run, STRIPE)


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """``lang, w1, w2, next, n`` of merged stripes: extensions of ``least`` or more, and with a null ``next`` each part's sum."""
    key = ["lang", "w1", "w2", "part"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None  # the stripe part that may go on: its key and its counter

        def close(keys: pa.Table, entries: pa.Table):
            """Rows of whole stripe parts: ``keys`` by number, ``entries`` of number, next, n."""
            sums = np.bincount(entries["run"].to_numpy(), entries["n"].to_numpy(), keys.num_rows).astype(np.int64)
            keep = entries.filter(pc.and_(pc.greater_equal(entries["n"], least), pc.not_equal(entries["next"], "")))
            of = pa.concat_arrays([pa.array(np.arange(keys.num_rows)), keep["run"].combine_chunks().cast(pa.int64())])
            table = keys.select(["lang", "w1", "w2"]).take(of)
            table = table.append_column("next", pa.chunked_array([pa.nulls(keys.num_rows, pa.string()), *keep["next"].chunks]))
            table = table.append_column("n", pa.chunked_array([pa.array(sums), *keep["n"].chunks]))
            yield from table.combine_chunks().to_batches()

        for batch in rows:
            if not batch.num_rows:
                continue
            keys = pa.table({k: batch.column(k) for k in key})
            new = np.zeros(batch.num_rows, bool)
            for k in key:
                c = batch.column(k)
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            of = np.cumsum(new)
            lists = batch.column("next")
            sizes = pc.list_value_length(lists).to_numpy()
            entries = pa.table({"run": np.repeat(of, sizes), "next": lists.flatten(), "n": batch.column("n").flatten()})
            firsts = keys.take(np.concatenate(([0], np.flatnonzero(new))))
            if held:
                if held[0].equals(firsts.slice(0, 1)):
                    entries = pa.concat_tables([held[1], entries])
                else:
                    yield from close(*held)
            entries = entries.group_by(["run", "next"]).aggregate([("n", "sum")]).rename_columns(["run", "next", "n"])
            last = firsts.num_rows - 1
            if last:
                yield from close(firsts.slice(0, last), entries.filter(pc.less(entries["run"], last)))
            rest = entries.filter(pc.equal(entries["run"], last))
            held = firsts.slice(last), rest.set_column(0, "run", pa.array(np.zeros(rest.num_rows, np.int64)))
        if held:
            yield from close(*held)

    return stripes.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "lang string, w1 string, w2 string, next string, n long")


def _pair_key_table(pairs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in rows:
            langs = np.array(batch.column("lang").to_pylist(), object)
            first, second = (_word_hashes([w.encode() for w in batch.column(c).to_pylist()]) for c in ("w1", "next"))
            out = np.zeros(len(langs), np.uint64)
            for lang in set(langs.tolist()):
                at = langs == lang
                out[at] = pair_keys(first[at], second[at], lang.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["key"])

    return pairs.select("lang", "w1", "next").mapInArrow(run, "key long")


def score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    d = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)}) as long)")


def collocations(docs: DataFrame, least: int = 10, cover: int = 50) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all phrases of 2 to 3 words found ``least`` times that no longer one covers.

    A phrase is covered by a longer one that holds its words and is found ``cover`` percent as often or more.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(4, math.isqrt(size >> 20))
    one = written(_merged(_stripes(texts, parts), least))
    pairs = one.where("next is not null").select("lang", "w1", F.col("next").alias("w2"), F.col("n").alias("a"))
    totals = written(one.where("next is null").groupBy("lang", "w1").agg(F.sum("n").alias("f")))
    of_lang = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    words = totals.where(F.col("f") >= least).select(F.struct("lang", F.col("w1").alias("w")).alias("word"), "f")
    keys = written(_pair_key_table(one.where("next is not null")))
    frequent = spark.sparkContext.broadcast(bloom(keys))
    two = _merged(_stripes(texts, parts, frequent), least)
    triples = written(two.where("next is not null").select("lang", "w1", "w2", F.col("next").alias("w3"), F.col("n").alias("a")))

    def with_count(left: DataFrame, w: str, name: str) -> DataFrame:
        left = left.withColumn("word", F.struct("lang", F.col(w).alias("w")))
        return spread_join(left, words.withColumnRenamed("f", name), "word", left.groupBy("word").agg(F.count("*").alias("n"))).drop("word")

    pairs = written(with_count(with_count(pairs, "w1", "l"), "w2", "r"))
    around = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("most"))
    two_words = pairs.join(around, ["lang", "w1", "w2"], "left").where(f"most is null or 100 * most < {cover} * a")
    two_words = two_words.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score("a", "l", "r").alias("score"))
    first = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    rest = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    cut = triples.join(first, ["lang", "w1", "w2"]).join(rest, ["lang", "w2", "w3"]).withColumns({"s1": score("a", "f1", "f23"), "s2": score("a", "f12", "f3")})
    early = F.col("s1") <= F.col("s2")
    three_words = cut.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    return two_words.unionByName(three_words).join(of_lang, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def strongest(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases with their ``rank``; a language's phrases are cut down in 64 parts first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = few.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strongest(collocations(scan(spark, sf_dir, "documents")))
