"""Line de-duplication over the whole corpus by a deletion-neighbourhood join.

Units are lines, white space and the case of A-Z left aside, and pieces of lines of more than ``LONG`` words, cut at words that
a hash picks, so that a passage that stands in different lines is cut alike in all of them. Blank lines are no units.
A unit goes if an earlier one, by document id, text, line and piece, is equal or, where both are lines of at least ``MIN_WORDS`` words,
differs by one inserted, deleted or replaced word. Shorter lines go only if equal, as one word is much of what they say,
and so do pieces: a longer line with several changes loses the pieces between them.
What a unit is near to may go itself; ``kept_*`` then name the unit at the start of that chain, which stays.

Two units that differ by one word share their first or their last words up to the edit, so only units with a partner for
one of these two hashes emit variants: themselves, and themselves without one word, at the places
the shared hash leaves open. Units that miss the same word at the same place, or of which one is the other
without a word, meet under one hashed key; each key is reduced to its earliest members, so no pairs are
formed within a group. Every pair found is verified word by word.

Rows without an id or a text have no units and stay as they are. Rows of one id with different texts are told apart by
a hash of the text; repeated rows share their places and are kept or dropped alike. A text of which every line goes
becomes empty; its row stays. An empty table gives an empty result; very long texts are compared whole; other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kgloom.llm.common import WHITE, batches, doc_text, scan, written

MIN_WORDS = 8
#: A longer line also has pieces, of LEAST words at least and about twice that on average; of MOST without a place to cut.
LONG, LEAST, MOST = 48, 16, 80
PIECE_BITS = 24
WORD = re.compile(r"[^ \t-\r]+")
BASE = 0x9E3779B97F4A7C15  # odd, for polynomial hashes modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

LINES = "doc_id long, version long, unit long, h1 long, h2 long, keys array<struct<key:long,part:int>>"
VARIANTS = "v long, p int, doc_id long, version long, unit long, text string"


def cuts(words: list[bytes]) -> list[int]:
    """Ends of the pieces of a line; none for one that has no pieces."""
    n, out, at = len(words), [], 0
    if n <= LONG:
        return out
    while n - at >= 2 * LEAST:
        end, last = at + LEAST, min(at + MOST, n - LEAST)
        while end < last and crc32(words[end - 1]) & 15:
            end += 1
        out.append(end)
        at = end
    return [*out, n]


def units(line: int, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Number and words of a line's units: the line's number, and in the low bits 0, or a piece's number from 1."""
    yield line << PIECE_BITS, words
    ends = cuts(words)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True) if ends else ()):
        yield (line << PIECE_BITS) + k + 1, words[a:b]


def halves(n: int) -> list[int]:
    """Of how many first and last words a line of ``n`` words has hashes.

    Their number is the same for lengths n and n + 1, but at multiples of eight, where both are taken. It's
    half of the shorter length at most, so an edit leaves one of the two whole.
    """
    return sorted({4 * (n // 8), 4 * ((n - 1) // 8)} - {0}) if n >= MIN_WORDS else []


def line_table(docs: DataFrame) -> DataFrame:
    """The units of ``doc_id, version, text``; keys: hashes of a line's first (part > 0) and last (part < 0) words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest, xxh64_digest

        for part, texts in batches(parts):
            hashes, keys, ends, number, keyed, per_doc = [], [], [], [], [0], []
            for t in texts:
                start = len(number)
                for i, x in enumerate((t or b"").lower().split(b"\n")):
                    if not (words := x.split()):
                        continue
                    for u, w in units(i, words):
                        number.append(u)
                        hashes.append(xxh3_128_digest(b" ".join(w)))
                        if not u & ((1 << PIECE_BITS) - 1):
                            for c in halves(len(w)):
                                keys += xxh64_digest(b" ".join(w[:c]), 2 * c), xxh64_digest(b" ".join(w[-c:]), 2 * c + 1)
                                ends += c, -c
                        keyed.append(len(keys))
                per_doc.append(len(number) - start)
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(texts)), per_doc))
            struct = pa.StructArray.from_arrays([pa.array(np.frombuffer(b"".join(keys), ">i8").astype(np.int64)), pa.array(ends, pa.int32())], names=["key", "part"])
            lists = pa.ListArray.from_arrays(pa.array(keyed, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(of), part.column("version").take(of), pa.array(number, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), lists],
                names=["doc_id", "version", "unit", "h1", "h2", "keys"],
            )

    return docs.mapInArrow(run, LINES)


def _variants(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of VARIANTS for the wanted units: p = -1 is the unit itself, with its text."""
    import numpy as np
    from xxhash import xxh3_128_digest
    from xxhash import xxh64_intdigest as digest

    for part, texts in batches(parts):
        cols: list[list] = [[], [], [], [], []]
        kept: list = []
        for doc, version, t, want in zip(*(part.column(c).to_pylist() for c in ("doc_id", "version")), texts, part.column("want").to_pylist(), strict=True):
            lines = (t or b"").lower().split(b"\n")
            for w in want:
                line = w["unit"] >> PIECE_BITS
                words = lines[line].split() if line < len(lines) else []
                joined = b" ".join(words)
                if tuple(np.frombuffer(xxh3_128_digest(joined), ">i8").tolist()) != (w["h1"], w["h2"]):
                    continue
                n = len(words)
                with np.errstate(over="ignore"):
                    power = np.cumprod(np.array([1] + [BASE] * (n - 1), np.uint64))
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.array([digest(x, 7) for x in words], np.uint64) * power)))
                    gone = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
                open_at = np.zeros(n, bool)
                for c in w["parts"]:
                    open_at[c if c > 0 else 0 : n if c > 0 else n + c] = True
                p = np.flatnonzero(open_at)
                cols[0].append(np.concatenate((sums[-1:], gone[p])).view(np.int64))
                cols[1].append(np.concatenate(([-1], p)))
                for col, x in zip(cols[2:], (doc, version, w["unit"]), strict=True):
                    col.append(np.full(len(p) + 1, x))
                kept += [joined.decode(), *[None] * len(p)]
        if kept:
            v, p, *place = map(np.concatenate, cols)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(p, pa.int32()), *(pa.array(c, pa.int64()) for c in place), pa.array(kept, pa.string())], names=["v", "p", "doc_id", "version", "unit", "text"])


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one edit at most."""
    # first place where they differ, from 1; 0 if one is the other
    i = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda x, at: F.slice(x, at, F.greatest(F.size(x), F.lit(1)))
    return (i == 0) | (rest(a, i + 1) == rest(b, i + 1)) | (rest(a, i + 1) == rest(b, i)) | (rest(a, i) == rest(b, i + 1))


def _chain_starts(near: DataFrame) -> DataFrame:
    """``place, kept, distance`` with ``kept`` followed to the unit that is near to no earlier one; rounds take turns with two tables."""
    run = uuid.uuid4().hex
    held = written(near, f"{run}-first")
    for i in range(64):
        on = held.select(F.col("place").alias("kept"), F.col("kept").alias("further"))
        moved = held.select("place", "kept", "distance").join(on, "kept", "left")
        held = written(moved.select("place", F.coalesce("further", "kept").alias("kept"), "distance", F.col("further").isNotNull().alias("moved")), f"{run}-{i % 2}")
        if held.where("moved").isEmpty():
            break
    return held.select("place", "kept", "distance")


def duplicate_units(docs: DataFrame) -> DataFrame:
    """``place, kept, distance``: units that go, and the first of what they repeat."""
    texts = doc_text(docs).where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    lines = written(line_table(texts))
    place = F.struct("doc_id", "version", "unit")
    of_line = F.min(F.when(F.size("keys") > 0, place))
    distinct = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), of_line.alias("line"), F.max("keys").alias("keys"), F.count("*").alias("n")))
    repeated = distinct.where("n > 1").select("h1", "h2", "first")
    exact = lines.select(place.alias("place"), "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("place") > F.col("first")).select("place", "first")

    parts = distinct.where("line is not null").select("h1", "h2", "line", F.inline("keys"))
    shared = written(parts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    wanted = (
        parts.join(shared, "key")
        .groupBy("line", "h1", "h2")
        .agg(F.collect_set("part").alias("parts"))
        .groupBy(F.col("line.doc_id").alias("doc_id"), F.col("line.version").alias("version"))
        .agg(F.collect_list(F.struct(F.col("line.unit").alias("unit"), "h1", "h2", "parts")).alias("want"))
    )
    variants = written(texts.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "want").mapInArrow(_variants, VARIANTS))
    by_place = variants.groupBy("v", "p").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    full, less = F.min(F.when(F.col("p") < 0, F.col("least"))), F.min(F.when(F.col("p") >= 0, F.col("least")))
    by_key = by_place.groupBy("v").agg(full.alias("full"), less.alias("less"), F.sum("n").alias("all")).where("`all` > 1")
    groups = written(by_place.join(by_key, "v").select("v", "p", "least", "full", "less"))
    earlier = lambda c: F.when(F.col(c) < place, F.col(c))
    partner = F.when(F.col("p") >= 0, F.least(earlier("least"), earlier("full"))).otherwise(earlier("less"))
    pairs = variants.join(groups, ["v", "p"]).select(place.alias("place"), partner.alias("kept")).where("kept is not null").groupBy("place").agg(F.min("kept").alias("kept"))
    whole = variants.where("p < 0").select(place.alias("place"), F.split("text", " ").alias("words")).dropDuplicates(["place"])
    other = whole.select(F.col("place").alias("kept"), F.col("words").alias("kept_words"))
    near = pairs.join(whole, "place").join(other, "kept").where(within_one_word(F.col("words"), F.col("kept_words"))).select("place", "kept", F.lit(1).alias("distance"))
    # lines that equal an earlier piece are near to nothing else then, but others may be near to them
    late = distinct.where("line > first").select(F.col("line").alias("place"), F.col("first").alias("kept"), F.lit(0).alias("distance"))
    near = _chain_starts(near.join(late, "place", "left_anti").union(late))
    starts = near.select(F.col("place").alias("first"), "kept")
    exact = exact.join(starts, "first", "left").select("place", F.coalesce("kept", "first").alias("kept"), F.lit(0).alias("distance"))
    return exact.union(near.where("distance = 1"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, piece, kept_doc_id, kept_line, kept_piece, distance``: units that go, and the first of what they repeat.

    ``piece``: null for a whole line. ``distance``: 0 if an earlier unit is equal, 1 if it differs by one word.
    """
    line = lambda c: F.shiftright(F.col(c), PIECE_BITS).cast("int")
    piece = lambda c: F.nullif(F.col(c).bitwiseAND((1 << PIECE_BITS) - 1), F.lit(0)).cast("int") - 1
    return duplicate_units(docs).select(
        "place.doc_id", line("place.unit").alias("line"), piece("place.unit").alias("piece"),
        F.col("kept.doc_id").alias("kept_doc_id"), line("kept.unit").alias("kept_line"), piece("kept.unit").alias("kept_piece"), "distance",
    )


def without_units(text: str, gone: set[int]) -> str:
    """The text without some of its lines, or pieces of them with the white space behind."""
    out = []
    for i, x in enumerate(text.split("\n")):
        if i << PIECE_BITS in gone:
            continue
        at = [m.start() for m in WORD.finditer(x)]
        ends = cuts(x.encode().lower().split()) if len(at) > LONG else []
        hit = [k for k in range(len(ends)) if (i << PIECE_BITS) + k + 1 in gone]
        if hit and len(hit) == len(ends):
            continue
        for k in reversed(hit):
            a = at[ends[k - 1]] if k else at[0]
            x = x[:a] + x[at[ends[k]] :] if ends[k] < len(at) else x[:a].rstrip(WHITE)
        out.append(x)
    return "\n".join(out)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the units that go; other columns stay as they are."""
    gone = duplicate_units(docs).groupBy("place.doc_id", "place.version").agg(F.collect_set("place.unit").alias("units"))
    same = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["version"])
    joined = docs.join(gone, same, "left").select(*(docs[c] for c in docs.columns), gone["units"].alias(f"units_{uuid.uuid4().hex}"))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t if u is None else without_units(t, set(u)) for t, u in zip(part.column(at).to_pylist(), part.columns[-1].to_pylist(), strict=True)]
            columns = [*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(run, StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(scan(spark, sf_dir, "documents"))
