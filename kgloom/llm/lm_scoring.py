"""Language-model scores: word unigrams as the base, and prediction by partial matching over bytes.

The byte model is a trie of contexts of up to ``ORDER`` bytes, counted over all training texts. A byte is coded in the
longest context that knows it; each context on the way costs an escape (estimated as half a count for each of its
distinct followers, which give up as much), and what a longer context has already ruled out is excluded from the shorter one's total. Counts don't
change while scoring, so exclusion depends on two neighbouring contexts only, and a byte's probability on itself and the ``ORDER``
bytes before it. So the distinct strings of the texts are scored, part by part of the trie; texts then look
theirs up and add. No string is left out, however many there are.

Null texts count as empty: one end token, and the end byte. Repeated rows are scored each on its own, and each
counts where it is learned from; very long texts are counted and scored whole; an empty table gives an empty result;
other columns are ignored. Without training texts every byte costs 1/256 and the base has N = V = 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import batches, doc_text, fold_of, scan, written

ORDER = 5
#: Words seen this often or more go to every executor, about this many; the rest are joined.
FREQUENT = 100_000
#: About so many strings of ORDER + 1 bytes make a part of the trie.
TRIE_GRAMS = 500_000
#: Texts are scored with so many strings' logarithms at a time; beyond, they are read again for the next ones.
PASS_GRAMS = 4_000_000
EMPTY = (1 << 64) - 1
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[bytes | None]):
    """Strings of ORDER + 1 bytes that end at each byte of each text or at its end byte, as numbers.

    Before and after a text stand zero bytes.
    """
    import numpy as np

    x = np.frombuffer(b"".join(b"\0" * ORDER + (t or b"") + b"\0" for t in texts), np.uint8).astype(np.uint64)
    n = np.array([len(t or b"") + 1 + ORDER for t in texts])
    out = np.zeros(max(0, len(x) - ORDER), np.uint64)
    for i in range(ORDER + 1):
        out = (out << np.uint64(8)) | x[i : len(x) - ORDER + i]
    place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)[: len(out)]
    return out[place < np.repeat(n - ORDER, n)[: len(out)]]


def _merge(keys, counts):
    import numpy as np

    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def corpus_counts(texts: DataFrame, with_words: bool = True) -> DataFrame:
    """``word, gram, n``: how often each token (gram null) and each byte string (word null) occurs in all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

        def words_out(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.nulls(len(held), pa.int64()), pa.array(held.values(), pa.int64())], schema=schema)

        held, keys, counts = Counter(), [], []
        for _, part in batches(parts):
            if with_words:
                for t in part:
                    held.update(tokens(t))
                held[END] += len(part)
            if len(held) > 1_000_000:
                yield words_out(held)
                held = Counter()
            k, n = np.unique(grams(part), return_counts=True)
            keys.append(k)
            counts.append(n)
            if len(keys) > 16:
                k, n = _merge(keys, counts)
                keys, counts = [k], [n]
        if held:
            yield words_out(held)
        if keys:
            k, n = _merge(keys, counts)
            for i in range(0, len(k), 1 << 20):
                m = len(k[i : i + (1 << 20)])
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.array(k[i : i + m].astype(np.int64)), pa.array(n[i : i + m])], schema=schema)

    counted = doc_text(texts).mapInArrow(run, "word binary, gram long, n long")
    return counted.groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Trie:
    """Contexts and their followers, level by level; all tables are arrays.

    ``pairs`` are counts of all strings of two bytes (0 for those that only precede a byte). With them, ``keys`` may be any
    strings of ORDER + 1 bytes, as long as those with the same two bytes before the last one are there together: longer
    contexts of a byte end in these two.
    """

    def __init__(self, keys, counts, pairs, pair_counts):
        import numpy as np

        keys, pairs = keys.astype(np.uint64), pairs.astype(np.uint64)
        top = ORDER + 1
        mask = self.mask = lambda k: np.uint64((1 << (8 * k)) - 1)
        byte = np.uint64(8)
        # nodes of a level: strings of so many bytes that end at a coded byte, or that precede one
        nodes, seen = [np.zeros(1, np.uint64)], [np.array([pair_counts.sum()])]
        for k in range(1, top + 1):
            whole, m = (pairs, pair_counts) if k <= 2 else (keys, counts)
            ends = whole & mask(k)
            n = np.unique(np.concatenate((ends, (whole >> byte) & mask(k)))) if k not in (2, top) else whole
            nodes.append(n)
            seen.append(np.bincount(np.searchsorted(n, ends), m, len(n)).astype(np.int64) if len(n) else np.zeros(0, np.int64))
        self.nodes = nodes
        find = lambda k, x: np.minimum(np.searchsorted(nodes[k], x), max(0, len(nodes[k]) - 1))
        self.first = np.concatenate(([0], np.cumsum([len(n) for n in nodes])))
        size = self.first[-1]
        total, kinds = np.zeros(size), np.zeros(size)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_count = np.log10(np.concatenate(seen) - 0.5)
            for k in range(top):
                down = nodes[k + 1]
                if not len(down):
                    continue
                up = find(k, down >> byte)
                ok = (nodes[k][up] == down >> byte) & (seen[k + 1] > 0)
                total[self.first[k] : self.first[k + 1]] = np.bincount(up[ok], seen[k + 1][ok], len(nodes[k]))
                kinds[self.first[k] : self.first[k + 1]] = np.bincount(up[ok], minlength=len(nodes[k]))
            self.used = kinds > 0
            self.size_plain = np.log10(total)
            self.escape_plain = np.log10(kinds / 2 / total)
            # what is left of the next shorter context once this one's followers are excluded
            self.size_left, self.escapes = np.zeros(size), np.zeros(size)
            for k in range(1, top):
                if not len(nodes[k]):
                    continue
                here = slice(self.first[k], self.first[k + 1])
                short = self.first[k - 1] + find(k - 1, nodes[k] & mask(k - 1))
                down = nodes[k + 1]
                up = find(k, down >> byte)
                ok = (nodes[k][up] == down >> byte) & (seen[k + 1] > 0)
                gone = np.bincount(up[ok], seen[k][find(k, down & mask(k))][ok], len(nodes[k]))
                left = np.maximum(total[short] - gone, 0)
                new = np.maximum(kinds[short] - kinds[here], 0)
                self.size_left[here] = np.where(left > 0, np.log10(left), 0)
                step = np.where(new > 0, np.log10(new / 2 / left), 0)
                self.escapes[here] = self.escapes[short] + step
        self.unknown = -np.log10(max(1.0, 256 - kinds[0]))
        for k in ("log_count", "size_plain", "escape_plain", "size_left", "escapes"):
            setattr(self, k, np.nan_to_num(getattr(self, k), neginf=-99.0).astype(np.float32))
        self.counted = np.concatenate(seen) > 0

    def score(self, wanted):
        """log10 probability of the last byte of each string of ORDER + 1 bytes after the others."""
        import numpy as np

        wanted = wanted.astype(np.uint64)
        n = len(wanted)

        def node(k, x):
            if not len(self.nodes[k]):
                return np.full(n, -1)
            i = np.minimum(np.searchsorted(self.nodes[k], x), len(self.nodes[k]) - 1)
            return np.where(self.nodes[k][i] == x, i + self.first[k], -1)

        at = [node(k, (wanted >> np.uint64(8)) & self.mask(k)) for k in range(ORDER + 1)]
        context, depth = np.zeros(n, np.int64), np.zeros(n, np.int8)
        for k in range(1, ORDER + 1):
            ok = (at[k] >= 0) & self.used[at[k]]
            context, depth = np.where(ok, at[k], context), np.where(ok, k, depth)
        follower, longer, found = np.full(n, -1), at[0], np.full(n, -1, np.int8)
        for k in range(ORDER + 1):
            down = node(k + 1, wanted & self.mask(k + 1))
            ok = (down >= 0) & self.counted[down] & (k <= depth)
            follower, found = np.where(ok, down, follower), np.where(ok, k, found)
            longer = np.where(ok, at[min(k + 1, ORDER)], longer)  # the context one byte longer than the one that knows it
        count = np.where(follower >= 0, self.log_count[follower], 0)
        direct = count - self.size_plain[context]
        escaped = self.escape_plain[context] + self.escapes[context] - self.escapes[longer] + np.where(follower >= 0, count - self.size_left[longer], self.unknown)
        return np.where((found == depth) & (found >= 0), direct, escaped).astype(np.float32)


def byte_logs(strings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, p``: for each string of ``wanted``, its last byte's log10 probability by the counts ``strings`` (``gram, n``).

    The trie is cut by the two bytes before the last, each part built and asked by itself.
    """
    import numpy as np

    ends = strings.select(F.col("gram").bitwiseAND(0xFFFF).alias("pair"), "n")
    before = strings.select(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("pair"), F.lit(0).cast("long").alias("n"))
    pairs = ends.union(before).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy()
    order = np.argsort(pair)
    sent = strings.sparkSession.sparkContext.broadcast((pair[order], n[order]))
    both = strings.select("gram", "n", F.lit(False).alias("wanted")).union(wanted.select("gram", F.lit(0).cast("long"), F.lit(True)))
    both = written(both.groupBy("gram").agg(F.sum("n").alias("n"), F.max("wanted").alias("wanted")))
    parts = -(-both.count() // TRIE_GRAMS) or 1

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("gram")
        gram, n, want = (part.column(c).to_numpy() for c in ("gram", "n", "wanted"))
        asked = gram[want]
        return pa.table({"gram": asked, "p": Trie(gram[n > 0], n[n > 0], *sent.value).score(asked)})

    part = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(0xFFFF)), F.lit(parts))
    return both.groupBy(part).applyInArrow(run, "gram long, p float")


def _slots(x, bits: int):
    import numpy as np

    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def hash_table(keys, values):
    """Keys and values by slot, with linear probing; EMPTY is no key."""
    import numpy as np

    keys = keys.astype(np.uint64)
    bits = max(4, int(2 * len(keys)).bit_length())
    slots, held = np.full(1 << bits, EMPTY, np.uint64), np.zeros(1 << bits, np.float32)
    at, left = _slots(keys, bits), np.arange(len(keys))
    while len(left):
        free = left[slots[at[left]] == EMPTY]
        slots[at[free]] = keys[free]
        here = slots[at[left]] == keys[left]
        held[at[left[here]]] = values[left[here]]
        left = left[~here]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return slots, held


def look_up(table, keys):
    """The keys' values, 0 for keys that the table hasn't."""
    import numpy as np

    slots, held = table
    at = _slots(keys, len(slots).bit_length() - 1)
    got = slots[at]
    out = np.where(got == keys, held[at], np.float32(0))
    left = np.flatnonzero((got != keys) & (got != EMPTY))
    at = at[left]
    while len(left):
        at = (at + 1) & (len(slots) - 1)
        got, key = slots[at], keys[left]
        hit = got == key
        out[left[hit]] = held[at[hit]]
        on = ~hit & (got != EMPTY)
        left, at = left[on], at[on]
    return out


def _more_scores(texts: DataFrame, sent, sums) -> DataFrame:
    """What the strings of a further pass add to each row's score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in batches(parts, 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sums(sent.value, batch), pa.float64())], names=["row", "score"])

    return written(texts.mapInArrow(run, "row long, score double"))


def lm_scores(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from ``train``."""
    import numpy as np

    counts = written(corpus_counts(train))
    words = counts.where("word is not null").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    # the counts' histogram by eighths of a doubling says from which count on the words are few enough
    bucket = F.floor(F.log2("n") * 8)
    held, least = 0, 1 << 62
    for b, n in sorted(((r.b, r["count"]) for r in words.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if (held := held + n) > FREQUENT:
            break
        least = b
    few = words.where(bucket >= least).toArrow()
    frequent = dict(zip(few.column("word").to_pylist(), few.column("n").to_pylist(), strict=True))
    logs = written(byte_logs(counts.where("word is null").select("gram", "n"), corpus_counts(docs, with_words=False).select("gram")))
    passes = -(-logs.count() // PASS_GRAMS) or 1
    of_pass = F.pmod(F.xxhash64("gram"), F.lit(passes))

    def table(i: int):
        got = logs.where(of_pass == i).toArrow()
        return hash_table(got.column("gram").to_numpy(), got.column("p").to_numpy())

    def sums(held, texts):
        sizes = np.array([len(t or b"") + 1 for t in texts])
        return np.add.reduceat(look_up(held, grams(texts)).astype(np.float64), np.cumsum(sizes) - sizes).tolist() if len(texts) else []

    context = docs.sparkSession.sparkContext
    sent = context.broadcast((frequent, table(0)))
    base = float(np.log10(total + kinds + 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = sent.value
        log = {w: float(x) for w, x in zip(known, np.log10(np.array(list(known.values()), np.float64) + 1), strict=True)}
        row = TaskContext.get().partitionId() << 40
        for part, texts in batches(parts, 1 << 20):
            numbers = part.column("row").to_pylist() if passes > 1 else range(row, row + len(texts))
            row += len(texts)
            scores = sums(held, texts)
            out: list[tuple] = []
            for at, doc, t, score in zip(numbers, part.column("doc_id").to_pylist(), texts, scores, strict=True):
                ts = [*tokens(t), END]
                hits = [log[w] for w in ts if w in log]
                # tokens hold no white space, so this key is nobody's word, and rows of documents spread evenly
                out.append((at, b" %d" % at, 1, doc, len(ts), len(hits), sum(hits) - len(ts) * base, score))
                if len(hits) < len(ts):
                    out += [(at, w, m, None, 0, 0, 0.0, None) for w, m in Counter([w for w in ts if w not in log]).items()]
            cols = list(zip(*out, strict=True))
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "word", "m", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    texts = doc_text(docs)
    if passes > 1:  # rows are named once for all passes
        texts = written(texts.withColumn("row", F.monotonically_increasing_id()))
    rows = texts.mapInArrow(run, "row long, word binary, m long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    for i in range(1, passes):
        rows = rows.unionByName(_more_scores(texts, context.broadcast(table(i)), sums), allowMissingColumns=True)
    rare = words.where(bucket < least)
    joined = rows.join(rare, "word", "left")
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.sum("base_score") + F.sum(F.coalesce(F.col("m") * F.log10(F.col("n") + 1), F.lit(0.0)))).alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    found = lm_scores(docs, docs.where(fold_of("doc_id", 7) != 2))
    return found.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
