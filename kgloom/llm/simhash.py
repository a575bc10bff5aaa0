"""SimHash near-duplicates by an inverted index on byte positions.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes, position for
position. Lists of single positions would hold one fingerprint in 256 each, and the pairs to tally would grow with the
square of the table (the README has figures). So the index is keyed by the values of four positions at once (70 such
keys): who shares a key has reached the guaranteed number of matches. The equal bytes of each pair are then tallied in full, which
also says the one key it belongs to, and the pair is verified bit by bit.

Nulls and texts without a word have fingerprint zero and are linked like any other. Equal fingerprints are one
entry of the index. Repeated rows share a component; rows without an id have one too, but don't name it. An empty
table gives an empty result; other columns are ignored; very long texts are hashed whole, in batches of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import batches, doc_text, scan, written
from kgloom.operators.components import connected_components, spread_join

BYTES, MATCHES, BITS = 8, 4, 4
#: A longer list of one key is cut into blocks that are compared pairwise by other tasks.
LONG_LIST, BLOCK = 8192, 2048


def bit_counts(hashes, sizes):
    """For groups of 64-bit hashes laid end to end, of ``sizes`` > 0: how often each bit is set; bit 0 first."""
    import numpy as np

    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    blocks = -(-sizes // 255)  # so that eight counters fit in eight bytes
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    at = np.repeat(starts - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    out = np.zeros((len(sizes), 64), np.int64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(0x0101010101010101), at)
        out[:, b::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: fp holds the 64 bits as a signed number."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest as digest

        for part, texts in batches(parts, 4 << 20):
            values: list[int] = []
            sizes = []
            for t in texts:
                words = (t or b"").lower().split()
                joined = b" ".join(words)
                if len(words) <= shingle:
                    new = [digest(joined, seed)] if words else []
                else:
                    size = np.fromiter(map(len, words), np.int64, len(words))
                    end = np.cumsum(size + 1) - 1
                    new = [digest(joined[a:b], seed) for a, b in zip((end - size).tolist(), end[shingle - 1 :].tolist(), strict=False)]
                values += new
                sizes.append(len(new))
            n = np.array(sizes, np.int64)
            fp = np.zeros(len(texts), np.uint64)
            if values:
                ones = 2 * bit_counts(np.array(values, np.uint64), n[n > 0]) > n[n > 0][:, None]
                fp[n > 0] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


def _postings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key: the positions' number in the upper half, their four bytes in the lower."""
    import numpy as np

    for part in parts:
        fp = part.column("fp").to_numpy().astype(np.int64)
        octets = fp.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
        for k, at in enumerate(combinations(range(BYTES), MATCHES)):
            key = sum(octets[:, p] << (8 * i) for i, p in enumerate(at)) | (k << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])


def _first_key():
    """For each set of equal positions as 8 bits, the first key that lies in it; -1 for fewer than four."""
    import numpy as np

    masks = [sum(1 << p for p in at) for at in combinations(range(BYTES), MATCHES)]
    return np.array([next((k for k, m in enumerate(masks) if m & x == m), -1) for x in range(256)])


def _tally(x):
    """For each difference of two fingerprints, which of their bytes are equal, as 8 bits."""
    import numpy as np

    return np.packbits(x.view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little").ravel() if len(x) else np.zeros(0, np.uint8)


def _linked(a, b, key: int, first):
    """Matrix of the pairs that are within the bit bound and belong to this key."""
    import numpy as np

    x = a[:, None] ^ b[None, :]
    near = np.bitwise_count(x) <= BITS
    i, j = np.nonzero(near)
    near[i, j] = first[_tally(x[i, j])] == key
    return near


def _spanning(fps, key: int, first) -> list[tuple[int, int]]:
    """Links that join all that is linked among ``fps``, each new member by one link only."""
    import numpy as np

    out, rest = [], np.array(fps, np.uint64)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            later = []
            for i in range(0, len(front), 256):
                near = _linked(front[i : i + 256], rest, key, first)
                got = near.any(axis=0)
                out += zip(front[i : i + 256][near[:, got].argmax(axis=0)].tolist(), rest[got].tolist(), strict=True)
                later.append(rest[got])
                rest = rest[~got]
            front = np.concatenate(later)
    return out


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; block >= 0: a row of a long run instead, a the key, b the fingerprint."""
    import numpy as np

    first = _first_key()

    def rows(a, b, block):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.int32())], names=["a", "b", "block"])

    held_key, held, long_at = None, [], 0  # the run that may go on in the next batch

    def close():
        nonlocal held, long_at
        out = []
        if held:
            fps = np.concatenate(held)
            if long_at or len(fps) > LONG_LIST:
                n = len(fps)
                out.append(rows(np.full(n, held_key), fps.view(np.int64), long_at + np.arange(n) // BLOCK))
            elif len(fps) > 1 and (found := _spanning(fps, held_key >> 32, first)):
                out.append(rows([_signed(x) for x, _ in found], [_signed(y) for _, y in found], [-1] * len(found)))
        held, long_at = [], 0
        return out

    for part in parts:
        key, fp = part.column("key").to_numpy(), part.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        if not len(key):
            continue
        edge = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        size = np.diff(edge)
        # runs of two inside the batch, all at once
        two = np.flatnonzero(size == 2)
        two = two[(two > 0) & (two < len(size) - 1)]
        x, y = fp[edge[two]], fp[edge[two] + 1]
        z = x ^ y
        good = (np.bitwise_count(z) <= BITS) & (first[_tally(z)] == key[edge[two]] >> 32)
        if good.any():
            yield rows(x[good].view(np.int64), y[good].view(np.int64), np.full(good.sum(), -1))
        more = np.flatnonzero(size > 2)
        for r in sorted({0, len(size) - 1, *more.tolist()}):
            if key[edge[r]] != held_key:
                yield from close()
                held_key = int(key[edge[r]])
            held.append(fp[edge[r] : edge[r + 1]])
            while sum(map(len, held)) > LONG_LIST:  # what is handed on leaves memory
                fps = np.concatenate(held)
                n = len(fps) // BLOCK * BLOCK
                yield rows(np.full(n, held_key), fps[:n].view(np.int64), long_at + np.arange(n) // BLOCK)
                held, long_at = [fps[n:]], long_at + n // BLOCK
    yield from close()


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``a, b``: enough links between the distinct fingerprints of ``fps`` to join all that are linked."""
    postings = fps.select("fp").distinct().mapInArrow(_postings, "key long, fp long")
    dealt = postings.repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_links, "a long, b long, block int"))
    links = found.where("block < 0").select("a", "b")
    long = found.where("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    if long.isEmpty():
        return links
    blocks = long.groupBy("key").agg((F.max("block") + 1).alias("n"))
    pairs = long.join(blocks, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def run(key, x):
        import numpy as np
        import pandas as pd

        fps, k, first = np.unique(x["fp"].to_numpy()).view(np.uint64), int(key[0]) >> 32, _first_key()
        got = _spanning(fps, k, first)
        return pd.DataFrame({"a": [_signed(p) for p, _ in got], "b": [_signed(q) for _, q in got]}, dtype="int64")

    return links.union(pairs.groupBy("key", "i", "j").applyInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id``: the component is named by its smallest document id."""
    fps = written(fingerprints(docs))
    per_fp = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = written(connected_components(fingerprint_links(per_fp)).select(F.col("node").alias("fp"), F.col("component").alias("class")))
    # only fingerprints with a link are in a class of more than themselves
    in_class = written(per_fp.join(joined, "fp").select("fp", "class", "least"))
    named = in_class.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_class = spread_join(in_class.select("fp", "class"), named.select("class", "component_id"), "class", named.select("class", "n"))
    by_fp = per_fp.join(of_class.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return spread_join(fps, by_fp, "fp", per_fp.select("fp", "n")).select("doc_id", "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(scan(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
