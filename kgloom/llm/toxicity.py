"""Toxicity by compression distance: one zstandard dictionary of toxic text and one of ordinary text.

Each text is cut into windows of a few words, each window is compressed with either dictionary, and the differences
in length, summed up per text, go through a calibrated logistic threshold. Both dictionaries hold the same common
ordinary text; one adds passages that labels mark as toxic (character runs far more frequent, by documents, in
toxic than in ordinary texts), the other as much ordinary text. Labels mark whole documents, most windows of which are
ordinary, so dictionaries of whole windows tell little (the README has figures). A filler that both know starts each
window, so that even short ones are compressed.

Null and empty texts are one window without words and get a score like any other; an empty table gives an empty
result; repeated rows are scored each on its own, very long texts whole. Null labels are not learned from, of several
labels of a document the highest counts; without labels every score is 0. A score of exactly 0.5 counts as toxic.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import annotate, doc_text, fold_of, scan
from kgloom.llm.language_id import TABLE

FILLER = b".".join(bytes((65 + i, 66 + i, 67 + i)) for i in range(12))
WORDS = 4


def windows(text: bytes | None) -> list[bytes]:
    x = (text or b"").translate(TABLE).split()
    return [FILLER + b" " + b" ".join(x[i : i + WORDS]) + b" " for i in range(0, max(1, len(x)), WORDS)]


def runs(text: bytes, sizes: tuple[int, ...] = (4, 5, 6, 7, 8, 10)) -> set[bytes]:
    """Character runs of the words of a text, each with a space on either side."""
    out = set()
    for w in set(text.translate(TABLE).split()):
        w = b" " + w + b" "
        for n in sizes:
            out.update([w[i : i + n] for i in range(len(w) - n + 1)])
    return out


def passages(toxic: list[bytes], ordinary: list[bytes], least_z: float, least_lift: float, most_bytes: int) -> list[bytes]:
    """Runs at least ``least_lift`` times as frequent in toxic texts, with a two-proportion z of at least ``least_z``.

    The clearest and longest come first, none lies within another; ``most_bytes`` bounds the dictionary.
    """
    a, b = Counter(), Counter()
    for t in toxic:
        a.update(runs(t))
    kept = {g for g, n in a.items() if n >= 4}  # rarer ones never reach the z wanted
    for t in ordinary:
        b.update(runs(t) & kept)
    n, m = len(toxic), len(ordinary)
    z = {}
    for g in kept:
        p = (a[g] + b[g]) / (n + m)
        z[g] = (a[g] / n - b[g] / m) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n + 1 / m))
    out: list[bytes] = []
    for g in sorted((g for g in kept if z[g] >= least_z and a[g] * (m + 1) >= least_lift * (b[g] + 1) * n), key=lambda g: (-round(z[g]), -len(g), g)):
        if not any(g in c for c in out):
            if sum(map(len, out)) + len(g) > most_bytes:
                break
            out.append(g)
    return out


def drawn_windows(texts: list[bytes], size: int, seed: int) -> bytes:
    """``size`` bytes of windows drawn evenly from all of all texts; fewer if there are no more."""
    r = random.Random(seed)
    most = size // WORDS  # so many windows are surely enough
    kept: list[bytes] = []
    seen = 0
    for t in texts:
        for w in windows(t):
            seen += 1
            at = len(kept) if len(kept) < most else r.randrange(seen)
            if at < most:
                kept[at : at + 1] = [w[len(FILLER) :]]
    r.shuffle(kept)
    return b"".join(kept)[:size]


class Model:
    """The two dictionaries and the calibration; compressors are made where they are used."""

    def __init__(self, toxic_dict: bytes, ordinary_dict: bytes):
        self.dicts, self.mean, self.scale, self.weights = (ordinary_dict, toxic_dict), None, None, None

    def compressors(self):
        import zstandard as zs

        made = []
        for content in self.dicts:
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            p = zs.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=4, target_length=32, strategy=zs.STRATEGY_LAZY2,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS,
            )
            d.precompute_compress(compression_params=p)
            made.append(zs.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return made

    @staticmethod
    def features(text: bytes | None, ordinary, toxic):
        import numpy as np

        w = windows(text)
        d = np.array([len(ordinary(x)) - len(toxic(x)) for x in w], np.float64)
        top, n = np.sort(d)[::-1][:8], len(d)
        over = [float((d >= k).sum()) for k in (2, 3, 4, 5, 6)]
        return [top[0], top[:3].mean(), top.mean(), d.mean(), math.log(n), *(x / n for x in over), *(x / math.sqrt(n) for x in over), min(over[2], 8), min(over[4], 8)]

    def calibrate(self, f, y, ridge: float = 0.3):
        import numpy as np

        self.mean, self.scale = f.mean(0), f.std(0) + 1e-9
        a = np.hstack(((f - self.mean) / self.scale, np.ones((len(f), 1))))
        w = np.zeros(a.shape[1])
        for _ in range(40):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve(a.T @ (a * (q * (1 - q) + 1e-9)[:, None]) + ridge * np.eye(len(w)), a.T @ (q - y) + ridge * w)
        self.weights = w
        return self

    def score(self, f):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(((f - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(texts: list[bytes], labels: list[int], least_z: float = 6.0, least_lift: float = 8.0, passage_bytes: int = 64 << 10, base_bytes: int = 8 << 10, seed: int = 5) -> Model | None:
    """Dictionaries from one half of the texts, calibration on the other, so that it isn't told what it knows."""
    import numpy as np

    if len(set(labels)) < 2:
        return None
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    half = 2 * len(order) // 3
    toxic = [texts[i] for i in order[:half] if labels[i]]
    ordinary = [texts[i] for i in order[:half] if not labels[i]]
    if not toxic or not ordinary:
        return None
    extra = b"\n".join(passages(toxic, ordinary, least_z, least_lift, passage_bytes)[::-1]) + b"\n"
    plain = drawn_windows(ordinary, base_bytes + len(extra), seed)
    base = plain[: -len(extra)] + FILLER
    model = Model(extra + base, plain[-len(extra) :] + base)
    ordinary_c, toxic_c = model.compressors()
    rest = order[half:]
    f = np.array([model.features(texts[i], ordinary_c, toxic_c) for i in rest])
    return model.calibrate(f, np.array([labels[i] for i in rest], np.float64))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most ``2 * sample`` documents, a third of about ``sample`` toxic, drawn by a hash of the id.

    Of rows of one id the least text is learned from.
    """
    one = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / 3 / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * sample / 3 / max(1, counts.get(0, 0))))
    # the limit holds what the rate already gives, so that the broadcast has a bound
    drawn = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30)).orderBy("doc_id").limit(2 * sample)
    rows = doc_text(docs).where("text is not null").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text.encode() for r in rows], [r.toxic for r in rows]


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        import numpy as np

        m = sent.value
        ordinary, toxic = m.compressors() if m else (None, None)
        return lambda texts: (pa.array(m.score(np.array([m.features(t, ordinary, toxic) for t in texts])) if m else np.zeros(len(texts))),)

    return annotate(doc_text(docs), ["doc_id"], "score double", prepare)


def op8_toxicity(spark: SparkSession, sf_dir: str, sample: int = 9000) -> DataFrame:
    docs, labels = scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels")
    model = fit(*labelled(docs, labels.where(fold_of("doc_id", 5) != 0), sample))
    return score_texts(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
