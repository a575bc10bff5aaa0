"""Bloom filters of bounded size over tables of well-mixed 64-bit keys.

They only spare work: a key that passes by mistake is counted exactly later on. Beyond ``MOST_WORDS`` the filter grows no
further and lets more keys pass, so what is sent to the workers is 32 MB at most at any size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 22
#: Where a key's four bits stand in its word; the low bits of a key choose the word. Smallest
#: hashes have few high bits, so these are left out.
SHIFTS = (24, 30, 36, 42)


def bloom(keys: DataFrame, most_words: int = MOST_WORDS):
    """The filter of a written table's column ``key``, as 64-bit words: sixteen bits a key while they last."""
    import numpy as np

    n, most = 1024, keys.count()
    while n < most_words and n * 4 < most:
        n *= 2
    bit = lambda s: f"shiftleft(1L, cast(shiftright(key, {s}) & 63 as int))"
    rows = keys.select((F.col("key").bitwiseAND(n - 1)).alias("word"), F.expr(" | ".join(map(bit, SHIFTS))).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return words


def holds(words, keys):
    """Which of ``keys`` (64-bit) may be in the filter."""
    import numpy as np

    k = keys.view(np.uint64)
    wanted = np.zeros(len(k), np.uint64)
    for s in SHIFTS:
        wanted |= np.uint64(1) << ((k >> np.uint64(s)) & np.uint64(63))
    return words[(k & np.uint64(len(words) - 1)).view(np.int64)] & wanted == wanted
