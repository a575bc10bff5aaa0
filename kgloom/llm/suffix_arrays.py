"""Removal of long repeated byte strings by suffix arrays that are sorted in two stages.

Which strings can repeat: every string of ``WINDOW`` bytes is dealt by the smallest hash of the ``GRAM``-byte strings in it, so equal strings
always meet. Neighbouring strings of one smallest hash form a piece; pieces whose hash occurs only once are left out.
Equal pieces count, and stand once. Pieces that share a hash are laid into one block of bytes, whose
suffixes are sorted: those smaller than their successor directly, the others induced from them by scans of the buckets, first
bytes in rising order. Adjacent suffixes with a common prefix of ``WINDOW`` bytes are equal strings; what stands
twice or more goes. The places found go back to the texts by the pieces' hashes.

A hash with more than ``HOT`` different pieces, of a passage in ever new surroundings say, has its strings dealt one by one, by a hash of
all their bytes, so each different string stands once however often it occurs. Which hashes occur twice, and which are
hot, tasks learn from two filters of bounded size; what these let through by mistake is sorted and found to be single.

Null texts are empty. Matches never cross texts; repeated rows are repeats of each other, whatever their ids. Texts
are read whole, very long ones in overlapping segments. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgloom.llm.bloom import bloom, holds
from kgloom.llm.common import batches, scan, written
from kgloom.operators.components import spread_join

WINDOW, GRAM = 200, 32
HOT = 1 << 14
#: Bytes of text that are hashed at once, and of a block of pieces.
SEGMENT, BLOCK = 1 << 18, 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, for polynomial hashes modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
PIECES = "key long, ph long, bytes binary, n long, h1 long, h2 long, at long"


def powers(n: int):
    """BASE and its inverse to the powers 0 to ``n`` - 1."""
    import numpy as np

    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (BASE, INVERSE))


def segments(texts: list[bytes | None], most: int = SEGMENT) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (number of the text, start, bytes) of about ``most`` bytes; those of one text overlap so that no string is cut."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t or b"") - WINDOW + 1), most):
            some.append((i, a, t[a : a + most + WINDOW - 1]))
            size += len(some[-1][2])
            if size >= most:
                yield some
                some, size = [], 0
    if some:
        yield some


def runs(some: list[tuple[int, int, bytes]], power):
    """Runs of neighbouring strings with one smallest hash: its value, first and last start in the group's bytes, number of
    the segment; and the values that stand twice close together, so that a run may repeat itself."""
    import numpy as np

    x = np.frombuffer(b"".join(s[2] for s in some), np.uint8)
    n = len(x)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[0][:n])))
        h = (sums[GRAM:] - sums[:-GRAM]) * power[1][: n - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
    least, span = h, 1
    wide = WINDOW - GRAM + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    sizes = np.array([len(s[2]) for s in some])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(some)), sizes)[: len(least)]
    valid = np.arange(len(least)) <= ends[of] - WINDOW
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new & valid)
    last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    values = least[first]
    # places of these values: a table of their low bits tells most others apart
    some_bits = np.zeros(1 << 16, bool)
    some_bits[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(some_bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = at[np.lexsort((at, h[at]))]
    twice = h[at[1:]][(h[at[1:]] == h[at[:-1]]) & (np.diff(at) <= wide)]
    return values.view(np.int64), first, last, of[first], np.unique(twice).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """``text, h1, h2``: whole texts and 128 bits that stand for them."""
    text = F.col("text").cast("string")
    return docs.select(text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")).where(F.octet_length("text") >= WINDOW)


def _counted(texts: DataFrame) -> DataFrame:
    """``key, n``: hashes by which strings are dealt, and their runs, long ones by length; one more where a run may repeat itself."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        power = powers(2 * SEGMENT + WINDOW)
        for _, found in batches(rows):
            keys, sizes = [], []
            for some in segments(found):
                values, first, last, _, twice = runs(some, power)
                keys += values, twice
                sizes += 1 + (last - first) // WINDOW, np.ones(len(twice), np.int64)
            if keys:
                values, of = np.unique(np.concatenate(keys), return_inverse=True)
                counts = np.bincount(of, np.concatenate(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _different(texts: DataFrame, warm) -> DataFrame:
    """``key, n``: of hashes that occur often, their different pieces, long ones by length."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        power, seen = powers(2 * SEGMENT + WINDOW), set()
        for _, found in batches(rows):
            out = []
            for some in segments(found):
                values, first, last, *_ = runs(some, power)
                ok = holds(warm.value, values)
                joined = b"".join(s[2] for s in some) if ok.any() else b""
                for key, a, b in zip(values[ok].tolist(), first[ok].tolist(), last[ok].tolist(), strict=True):
                    piece = key, digest(joined[a : b + WINDOW], 1) - (1 << 63)
                    if piece not in seen:
                        seen.add(piece)
                        out.append((*piece, 1 + (b - a) // WINDOW))
                if len(seen) > 1 << 20:
                    seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["key", "ph", "n"])

    return texts.select("text").mapInArrow(run, "key long, ph long, n long").dropDuplicates(["key", "ph"]).groupBy("key").agg(F.sum("n").alias("n"))


def _pieces(texts: DataFrame, shared, hot) -> DataFrame:
    """Rows of PIECES: pieces with their bytes (once a task) and counts; and where (``at``) in which texts they stand."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest as digest

        power, again, seen = powers(2 * SEGMENT + WINDOW), {}, set()

        def table(columns: dict) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"bytes": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

        def counts():
            rest = [(k, p, n) for (k, p), n in again.items() if n]
            for i in range(0, len(rest), 50_000):
                k, p, n = zip(*rest[i : i + 50_000], strict=True)
                yield table({"key": k, "ph": p, "n": n})
            again.clear()

        for part, found in batches(rows):
            h1, h2 = (part.column(c).to_pylist() for c in ("h1", "h2"))
            for some in segments(found):
                values, first, last, of, _ = runs(some, power)
                ok = holds(shared.value, values)
                warm = holds(hot.value, values[ok])
                starts = np.cumsum([0, *(len(s[2]) for s in some)])[:-1]
                new = {c: [] for c in ("key", "ph", "bytes", "n")}
                places = {c: [] for c in ("key", "ph", "h1", "h2", "at")}
                fresh = {}
                for key, a, b, s, w in zip(values[ok].tolist(), first[ok].tolist(), last[ok].tolist(), of[ok].tolist(), warm.tolist(), strict=True):
                    i, start, t = some[s]
                    a, b = a - int(starts[s]), b - int(starts[s])
                    text = h1[i], h2[i]
                    if text not in fresh:
                        fresh[text] = (text, start) not in seen
                        if len(seen) < 1 << 20:
                            seen.add((text, start))
                    for x, y in ([(p, p) for p in range(a, b + 1)] if w else [(a, b)]):
                        piece = t[x : y + WINDOW]
                        ph = digest(piece, 1) - (1 << 63)
                        k = ph if w else key
                        if (k, ph) in again:
                            again[k, ph] += 1
                        else:
                            again[k, ph] = 0
                            for c, v in zip(new, (k, ph, piece, 1), strict=True):
                                new[c].append(v)
                        if fresh[text]:
                            for c, v in zip(places, (k, ph, *text, start + x), strict=True):
                                places[c].append(v)
                if new["key"]:
                    yield table(new)
                if places["key"]:
                    yield table(places)
            if len(again) > 1 << 19:
                yield from counts()
        yield from counts()

    names = [c.split()[0] for c in PIECES.split(", ")]
    return texts.mapInArrow(run, PIECES)


def two_stage_order(x, wanted, depth: int):
    """The wanted suffixes of the bytes ``x``, and those that they are induced from, sorted by their first ``depth`` bytes.

    A suffix smaller than its successor is sorted directly; any other is as its successor with one byte before it, so
    scans of the buckets of first bytes, in rising order, put it in its place.
    """
    import numpy as np

    n = len(x)
    at = np.arange(n)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(x[1:].astype(np.int16) - x[:-1])
    step[-1] = -1  # the end is smaller than all
    following = np.minimum.accumulate(np.where(step != 0, at, n - 1)[::-1])[::-1]
    smaller = step[following] > 0
    # a suffix is needed if wanted, or if its predecessor is needed and is induced
    last_wanted = np.maximum.accumulate(np.where(wanted, at, -1))
    last_smaller = np.concatenate(([-1], np.maximum.accumulate(np.where(smaller, at, -1))[:-1]))
    needed = last_wanted > last_smaller
    induced = needed & ~smaller

    direct = np.flatnonzero(needed & smaller)
    data = x.tobytes()
    slices = [data[p : p + depth] for p in direct.tolist()]
    direct = direct[np.array(sorted(range(len(slices)), key=slices.__getitem__), np.int64)] if slices else direct
    del slices
    edges = np.searchsorted(x[direct], np.arange(257))

    # where the run of one induced byte begins that a suffix ends
    breaks = np.ones(n, bool)
    breaks[1:] = (x[1:] != x[:-1]) | ~induced[:-1]
    run_start = np.maximum.accumulate(np.where(breaks, at, 0))
    heads: list[list] = [[] for _ in range(256)]
    if induced[n - 1]:
        heads[x[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        came = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        heads[c] = []
        if len(came):  # the same byte before them: the shorter runs first, each as they came
            back = came - run_start[came]
            which = np.repeat(np.arange(len(came)), back + 1)
            step_back = np.arange(len(which)) - np.repeat(np.cumsum(back + 1) - back - 1, back + 1)
            came = (came[which] - step_back)[np.lexsort((which, step_back))]
        bucket = np.concatenate((came, direct[edges[c] : edges[c + 1]]))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (x[before] > c)]
        if len(before):
            to = x[before]
            before = before[np.argsort(to, kind="stable")]
            counts = np.bincount(to, minlength=256)
            ends = np.cumsum(counts)
            for d in np.flatnonzero(counts).tolist():
                heads[d].append(before[ends[d] - counts[d] : ends[d]])
    return np.concatenate(out)


def common_prefixes(x, order, depth: int):
    """Bytes that each suffix of ``order`` shares with the next one, ``depth`` at most."""
    import numpy as np

    data = x.tobytes() + bytes(8)
    words = np.ndarray((len(x) + 1,), "<u8", data, strides=(1,))
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for d in range(0, depth, 8):
        p, q = a[left] + d, b[left] + d
        inside = np.maximum(p, q) < len(x)
        left, p, q = left[inside], p[inside], q[inside]
        differ = words[p] ^ words[q]
        low = differ & (~differ + np.uint64(1))
        out[left] = d + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        left = left[differ == 0]
    return np.minimum(out, np.minimum(len(x) - np.maximum(a, b), depth))


def repeated_starts(pieces: list[bytes], weights: list[int], window: int = WINDOW):
    """For each piece, which of its strings of ``window`` bytes stand more than once, pieces counted by ``weights``."""
    import numpy as np

    x = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(pieces)), sizes)
    wanted = np.arange(len(x)) <= ends[of] - window
    order = two_stage_order(x, wanted, window)
    order = order[wanted[order]]
    shared = common_prefixes(x, order, window)
    first = np.flatnonzero(np.concatenate(([True], shared < window)))
    n = np.add.reduceat(np.array(weights)[of[order]], first)
    twice = np.zeros(len(x), bool)
    twice[order] = np.repeat(n > 1, np.diff(np.append(first, len(order))))
    return [twice[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _repeats(pieces: DataFrame) -> DataFrame:
    """``piece, spans``: within a piece, the bytes that repeated strings cover."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        block, size = {}, 0  # by (key, ph): bytes and count

        def close():
            nonlocal block, size
            keys = list(block)
            marks = repeated_starts([v[0] for v in block.values()], [v[1] for v in block.values()]) if keys else []
            block, size = {}, 0
            found = []
            for k, m in zip(keys, marks, strict=True):
                if m.any():
                    edge = np.diff(np.concatenate(([0], m.view(np.int8), [0])))
                    found.append((*k, np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + WINDOW - 1))
            for i in range(0, len(found), 20_000):
                key, ph, a, b = zip(*found[i : i + 20_000], strict=True)
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, a)]), pa.int32()), spans)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ph, pa.int64()), lists], names=["key", "ph", "spans"])

        last = None
        for part in rows:
            for key, ph, text, n in zip(*(part.column(c).to_pylist() for c in ("key", "ph", "bytes", "n")), strict=True):
                if key != last:
                    if size >= BLOCK:
                        yield from close()
                    last = key
                held = block.setdefault((key, ph), [b"", 0])
                if text and not held[0]:
                    held[0] = text
                    size += len(text)
                held[1] += n
        yield from close()

    dealt = pieces.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, ph long, spans array<struct<start:long,end:long>>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``h1, h2, spans``: texts by their hashes (see ``_texts``), and the bytes that repeated strings cover, sorted, not joined."""
    spark = docs.sparkSession
    texts = _texts(docs)
    counts = written(_counted(texts).where("n > 1"))
    shared = spark.sparkContext.broadcast(bloom(counts.select("key")))
    many = counts.where(F.col("n") > HOT).select("key")
    if not many.isEmpty():  # most of what is frequent are copies, which stand once
        many = written(_different(texts, spark.sparkContext.broadcast(bloom(many))).where(F.col("n") > HOT).select("key"))
    hot = spark.sparkContext.broadcast(bloom(many))
    rows = written(_pieces(texts, shared, hot))
    found = _repeats(rows.where("h1 is null").select("key", "ph", "bytes", "n"))
    found = written(found.select(F.struct("key", "ph").alias("piece"), "spans"))
    places = rows.where("h1 is not null").select(F.struct("key", "ph").alias("piece"), "h1", "h2", "at")
    met = spread_join(places, found, "piece", places.groupBy("piece").agg(F.count("*").alias("n")))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    return met.select("h1", "h2", F.explode(moved).alias("span")).groupBy("h1", "h2").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def without_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_bytes``, the maximal ``removed`` runs of bytes, and the ``kept`` bytes, joined."""
    spans = written(repeated_spans(docs))
    text = docs["text"].cast("string")
    name = f"spans_{uuid.uuid4().hex}"
    same = (F.xxhash64(text) == spans["h1"]) & (F.xxhash64(F.lit(7), text) == spans["h2"])
    kept = [c for c in dict.fromkeys(keep) if c not in ("n_bytes", "removed", "kept")]
    joined = docs.join(spans, same, "left").select(*(docs[c] for c in kept), text.alias("text" if "text" not in kept else f"text_{name}"), spans["spans"].alias(name))
    new = StructType.fromDDL("n_bytes long, removed array<struct<start:long,end:long>>, kept binary")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            texts, lists = part.column(len(kept)).cast(pa.binary()), part.column(len(kept) + 1)
            start, size = 0, 0
            for i in range(part.num_rows):
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size < 8 << 20 and i < part.num_rows - 1:
                    continue
                sizes, removed, rest = [], [], []
                for t, s in zip(texts[start : i + 1].to_pylist(), lists[start : i + 1].to_pylist(), strict=True):
                    t, joint = t or b"", []
                    for x in s or ():
                        if joint and x["start"] <= joint[-1]["end"]:
                            joint[-1]["end"] = max(joint[-1]["end"], x["end"])
                        else:
                            joint.append(x)
                    cut = [0, *(p for x in joint for p in (x["start"], x["end"])), len(t)]
                    sizes.append(len(t))
                    removed.append(joint)
                    rest.append(b"".join(t[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)))
                fixed = [part.column(k).slice(start, i + 1 - start) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(rest, pa.binary())], names=[*kept, *new.names])
                start, size = i + 1, 0

    return joined.mapInArrow(run, StructType([*(joined.schema[c] for c in kept), *new.fields]))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(scan(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
