"""Hard negatives of labelled vectors, by bounds along spanning trees of anchors.

A score is the inner product of the vectors in whole numbers, floor(256 x). Anchors that lie close together share a block, whose
minimum spanning tree orders them. A tree's root is scored against every candidate; from a parent's score a child's
lies within the length of their edge times the norm of the candidate, above and below, and so on down the tree. Only
candidates whose bounds overlap the child's window are scored again, which makes their bounds exact.

Candidates are dealt by a hash into chunks of bounded bytes. A task holds one chunk and streams the blocks of anchors
past it, and hands on what could be among the best of each anchor; so a chunk's work is the same whatever the labels, ids or copies,
and all rows are compared with all anchors. Positives come from a first pass; their scores are the windows of a second.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Rows that agree in id, label and
vector count once; other rows of an anchor's own id are no partners of it. Shorter vectors score as if filled
up with zeros; vectors without components score 0. An anchor without positives, or a positive without rows in its window, has no row. Ties
go to smaller ids. An empty table gives an empty result. Scores beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import scan, written

#: Anchors of one tree, candidates that are bounded at once, bytes of a chunk's numbers.
BLOCK, SLICE, CHUNK_BYTES = 256, 4096, 32 << 20
PIVOTS = 64
POSITIVES = "key long, positive_id long, positive_score long"
NEGATIVES = "key long, positive_id long, positive_score long, negative_id long, negative_score long"


def whole(vectors: pa.Array, width: int):
    """floor(256 x) of a list array as rows of ``width`` doubles, shorter ones filled up."""
    import numpy as np

    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def spanning_tree(x) -> list[tuple[int, int, float]]:
    """Rows of ``x`` in an order in which parents come first: row, parent (-1: the root), length of the edge."""
    import numpy as np

    squares = (x * x).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0))
    least, parent, out = np.full(len(x), np.inf), np.full(len(x), -1), []
    at, left = 0, np.ones(len(x), bool)
    for _ in range(len(x)):
        left[at] = False
        # the length again, free of the rounding of the formula above
        out.append((at, int(parent[at]), float(np.linalg.norm(x[at] - x[parent[at]])) if parent[at] >= 0 else 0.0))
        nearer = left & (apart[at] < least)
        least[nearer], parent[nearer] = apart[at][nearer], at
        at = int(np.where(left, least, np.inf).argmin()) if left.any() else at
        if not left[at] and left.any():  # lengths may all be infinite
            at = int(left.argmax())
    return out


def products(x, y):
    """Inner products of the rows of ``x`` with ``y``, exact, as whole numbers."""
    import numpy as np

    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, len(y))
    if most < 1 << 53:
        return (x @ y).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, y.tolist(), strict=True)) for row in x.tolist()]
    return np.array(exact, np.int64)


def _first(scores, ids, k: int):
    """Places of the first ``k`` by falling score, then rising id."""
    import numpy as np

    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return few[np.lexsort((ids[few], -scores[few]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _walk(q, norm, x, wanted):
    """Scores down the tree of the anchors ``x`` over the candidates ``q``.

    ``wanted(anchor, low, high)`` gives the candidates to score; it is called again with exact scores as ``wanted(anchor, at, scores)``.
    """
    import numpy as np

    low, high = np.empty((len(x), len(q))), np.empty((len(x), len(q)))
    for at, parent, apart in spanning_tree(x):
        if parent < 0:
            low[at], high[at] = -np.inf, np.inf
            need = np.arange(len(q))
        else:
            reach = norm * (apart * (1 + 1e-9)) + 1e-6
            slack = 1e-12 * np.maximum(np.abs(low[parent]), np.abs(high[parent]))  # of the sums' rounding
            low[at], high[at] = low[parent] - reach - slack, high[parent] + reach + slack
            need = wanted.window(at, low[at], high[at])
        scores = products(q[need], x[at])
        low[at, need] = high[at, need] = scores
        wanted.take(at, need, scores)


class _Search:
    """The best candidates of one block's anchors within one chunk."""

    def __init__(self, anchors: dict, k: int):
        self.anchors, self.k, self.best = anchors, k, {}

    def over(self, ids, labels) -> _Search:
        self.ids, self.labels = ids, labels
        return self

    def keep(self, slot, at, scores) -> None:
        import numpy as np

        old = self.best.get(slot)
        s, i = (scores, self.ids[at]) if old is None else (np.concatenate((old[0], scores)), np.concatenate((old[1], self.ids[at])))
        first = _first(s, i, self.k)
        self.best[slot] = s[first], i[first]


class _Positives(_Search):
    def _mine(self, a):
        return (self.labels == self.anchors["label"][a]) & (self.ids != self.anchors["vec_id"][a])

    def window(self, a, low, high):
        import numpy as np

        mine = np.flatnonzero(self._mine(a))
        old = self.best.get(a)
        least = old[0][-1] if old is not None and len(old[0]) == self.k else -np.inf
        if len(mine) > self.k:
            least = max(least, np.partition(low[mine], -self.k)[-self.k])
        return mine[high[mine] >= least]

    def take(self, a, at, scores) -> None:
        mine = self._mine(a)[at]
        if mine.any():
            self.keep(a, at[mine], scores[mine])

    def rows(self):
        return [(self.anchors["key"][a], i, s) for a, (ss, ii) in self.best.items() for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]


class _Negatives(_Search):
    def __init__(self, anchors: dict, k: int, low: int, high: int):
        super().__init__(anchors, k)
        self.low, self.high = low, high

    def _others(self, a):
        return (self.labels != self.anchors["label"][a]) & (self.ids != self.anchors["vec_id"][a])

    def window(self, a, low, high):
        import numpy as np

        inside = np.zeros(len(low), bool)
        for p in self.anchors["positives"][a]:
            slack = 1 + 1e-9 * abs(p["positive_score"])
            inside |= (high >= self.low * p["positive_score"] / 100 - slack) & (low <= self.high * p["positive_score"] / 100 + slack)
        return np.flatnonzero(inside & self._others(a))

    def take(self, a, at, scores) -> None:
        others = self._others(a)[at]
        for n, p in enumerate(self.anchors["positives"][a]):
            inside = others & (scores >= -(-self.low * p["positive_score"] // 100)) & (scores <= self.high * p["positive_score"] // 100)
            if inside.any():
                self.keep((a, n), at[inside], scores[inside])

    def rows(self):
        out = []
        for (a, n), (ss, ii) in self.best.items():
            p = self.anchors["positives"][a][n]
            out += [(self.anchors["key"][a], p["positive_id"], p["positive_score"], i, s) for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
        return out


def clean(vectors: DataFrame, vector: str, relabel: Column | None) -> DataFrame:
    """``vec_id, label, vector, key`` of the rows that take part, each once."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & sound)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), (label if relabel is None else relabel).alias("label"), F.col(vector).alias("vector"))
    return kept.dropDuplicates(["vec_id", "label", "vector"]).withColumn("key", F.xxhash64("vec_id", "label", "vector"))


def anchor_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """``anchors`` with the number of their ``block``: by the nearest of 64 pivots and the distance to it, 256 at most in each."""
    few = anchors.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).select("vector").toArrow().column("vector").combine_chunks()
    n = anchors.count()
    places = anchors.select("vector", "key")

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pivots = whole(few, width)
        for part in parts:
            x = whole(part.column("vector"), width)
            apart = (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
            by = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(by), pa.array(apart[np.arange(len(x)), by])], names=["key", "pivot", "apart"])

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        seen, first = 0, TaskContext.get().partitionId() << 32
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(first + (seen + np.arange(part.num_rows)) // BLOCK)], names=["key", "block"])
            seen += part.num_rows

    placed = written(places.mapInArrow(nearest, "key long, pivot long, apart double"))
    order = ["pivot", "apart", "key"]
    numbered = placed.repartitionByRange(max(1, n // (64 * BLOCK)), *order).sortWithinPartitions(*order).mapInArrow(number, "key long, block long")
    return written(anchors.join(written(numbered), "key"))


def _passed(candidates: DataFrame, anchors: DataFrame, chunks: int, width: int, search, schema: str) -> DataFrame:
    """What ``search`` finds for each anchor in each chunk; a task holds one chunk at a time, and one block."""
    targets = "array<struct<positive_id:long,positive_score:long>>"
    here = candidates.select(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"), F.lit(-1).cast("long").alias("block"), "key", "vec_id", "label", "vector", F.lit(None).cast(targets).alias("positives"))
    there = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select(F.col("chunk").cast("long").alias("chunk"), "block", "key", "vec_id", "label", "vector", "positives")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        chunk, held, q = None, [], None
        block, some = None, []

        def build():
            nonlocal q, held
            if q is None:
                t = pa.Table.from_batches(held).combine_chunks() if held else None
                numbers = whole(t["vector"].combine_chunks(), width) if t else np.zeros((0, width))
                q = numbers, np.sqrt((numbers * numbers).sum(1)) * (1 + 1e-12), t["vec_id"].to_numpy() if t else np.zeros(0, np.int64), t["label"].to_numpy() if t else np.zeros(0, np.int64)
                held = []

        def close():
            nonlocal some
            if some:
                build()
                t = pa.Table.from_batches(some).combine_chunks()
                some = []
                x = whole(t["vector"].combine_chunks(), width)
                found = search({"key": t["key"].to_pylist(), "vec_id": t["vec_id"].to_numpy(), "label": t["label"].to_numpy(), "positives": t["positives"].to_pylist()})
                for i in range(0, len(q[0]), SLICE):
                    _walk(q[0][i : i + SLICE], q[1][i : i + SLICE], x, found.over(q[2][i : i + SLICE], q[3][i : i + SLICE]))
                if rows := found.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for part in parts:
            if not part.num_rows:
                continue
            at = np.stack([part.column("chunk").to_numpy(), part.column("block").to_numpy()])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = int(at[0, a]), int(at[1, a])
                if now != (chunk, block):
                    yield from close()
                    if now[0] != chunk:
                        held, q = [], None
                    chunk, block = now
                (held if block < 0 else some).append(part.slice(a, b - a))
        yield from close()

    return here.unionByName(there).repartition("chunk").sortWithinPartitions("chunk", "block").mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: str, vector: str = "embedding", relabel: Column | None = None, k: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor``: SQL condition on ``vec_id``. Positives: the first ``k`` rows of an anchor's label; negatives: the first ``k`` of
    other labels with a score of ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = written(clean(vectors, vector, relabel))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).head()
    width = max(1, width or 0)
    most = max(1024, CHUNK_BYTES // (8 * width))
    chunks = max(-(-n // most), min(-(-n // 1024), 2 * spark.sparkContext.defaultParallelism), 1)
    anchors = anchor_blocks(rows.where(is_anchor), width)
    ids = anchors.select("key", F.col("vec_id").alias("anchor_id"))

    none = F.lit(None).cast("array<struct<positive_id:long,positive_score:long>>")
    near = _passed(rows, anchors.withColumn("positives", none), chunks, width, lambda a: _Positives(a, k), POSITIVES)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    of = near.withColumn("place", place).where(F.col("place") <= k).groupBy("key").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = written(anchors.join(of, "key"))
    found = _passed(rows, asked, chunks, width, lambda a: _Negatives(a, k, low, high), NEGATIVES)
    rank = F.row_number().over(Window.partitionBy("key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(ids, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(scan(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", relabel=moved)
