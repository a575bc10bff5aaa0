"""Language identification with blended-spectrum string kernels.

A text is the set of its byte n-grams of one to three bytes, after lower-casing A-Z and turning every other ASCII
character into a space. The kernel of two texts is the size of the common set over the root of the product of
their sizes. Landmark texts span a Nyström space in which one ridge regression per language is fitted in
closed form; whole batches of texts are scored by matrix products. Common grams are counted in whole numbers, kernels
and weights are multiples of 2**-16, so all sums are exact and a text's score does not depend on its neighbours.

Texts that are null or have no letter are ``und`` with score 0, as is every text if nothing can be learned; an empty
table gives an empty result. Rows without a language are not learned from. Repeated rows are judged each on its own,
ties go to the language first by name, and very long texts are read whole, as any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import annotate, batches, doc_text, fold_of, scan

#: Bytes as the kernel sees them.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Grams of 1, 2 and 3 bytes have numbers of their own.
ONE, TWO, GRAMS = 1 << 24, (1 << 24) + (1 << 16), (1 << 24) + (1 << 16) + 256
#: A dense matrix of presences has no more cells, whatever the number of texts.
DENSE = 1 << 22
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode()))


def _codes(texts: list[bytes | None]):
    """Numbers of the three-byte strings that end at each byte of each text, two spaces standing before it; how many each has."""
    import numpy as np

    parts = [b"  " + (t or b"").translate(TABLE) for t in texts]
    n = np.array([len(p) for p in parts])
    x = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    # what ends at one of the two spaces reaches back into the neighbour
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    return code[place[2:] >= 2], n - 2


def gram_sets(texts: list[bytes | None]) -> list:
    """Sorted gram numbers of each text. Grams that start in the two spaces before a text count as its own."""
    import numpy as np

    out = []
    for t in texts:
        three = np.unique(_codes([t])[0])
        out.append(np.concatenate((three, np.unique(three & 0xFFFF) + ONE, np.unique(three & 0xFF) + TWO)))
    return out


def _exact(x):
    """Multiples of 2**-16: sums of products of two such numbers have no rounding error."""
    import numpy as np

    return np.round(x * 65536.0)


def fit(sets: list, labels: list[str], landmarks: int, ridge: float) -> dict | None:
    """The model: feature number of each gram, landmark matrix, and weights from landmark kernels to languages.

    Landmarks are the first texts of each language in the order given.
    """
    import numpy as np

    langs = sorted(set(labels))
    if not langs:
        return None
    chosen = [i for g in langs for i in [i for i, x in enumerate(labels) if x == g][:landmarks]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    index = np.full(GRAMS, -1, np.int32)
    index[grams] = np.arange(len(grams))

    def rows(which):
        m = np.zeros((len(which), len(grams)), np.float32)
        for r, i in enumerate(which):
            f = index[sets[i]]
            m[r, f[f >= 0]] = 1
        return m

    marks = rows(chosen)
    size = np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))
    kernel = lambda m: _exact((m @ marks.T) / np.sqrt(np.maximum(m.sum(axis=1, dtype=np.float64), 1))[:, None] / size) / 65536.0
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64) / size[:, None] / size)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    part = max(1, DENSE // len(grams))
    near = np.vstack([kernel(rows(range(i, min(i + part, len(sets))))) for i in range(0, len(sets), part)])
    phi = np.hstack((near @ root, np.ones((len(sets), 1))))
    want = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # languages weigh alike however many texts each has
    weight = 1.0 / np.array([labels.count(x) for x in labels])[:, None]
    w = np.linalg.solve(phi.T @ (phi * weight) + ridge * np.eye(phi.shape[1]), phi.T @ (want * weight))
    return {"langs": langs, "grams": grams, "marks": marks, "size": size, "weights": _exact(root @ w[:-1]), "bias": w[-1]}


def training_sets(docs: DataFrame, per_language: int, most_languages: int = 1000) -> tuple[list, list[str]]:
    """Gram sets and languages of at most ``per_language`` texts of each, drawn by a hash of the id.

    ``most_languages``: bound on the number of languages, the most frequent ones.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2.0 * per_language / r["count"]))])[F.col("lang")]
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(parts):
            ok = [i for i, t in enumerate(texts) if has_letter(t)]
            sets = gram_sets([texts[i] for i in ok])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ok, pa.int64())), part.column("lang").take(pa.array(ok, pa.int64())), pa.array([x.tolist() for x in sets], pa.list_(pa.int32()))], names=["doc_id", "lang", "grams"])

    import numpy as np

    sets, labels, seen = [], [], {}
    rows = drawn.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, grams array<int>").collect()
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        if seen.setdefault(r.lang, 0) < per_language:
            seen[r.lang] += 1
            sets.append(np.array(r.grams, np.int32))
            labels.append(r.lang)
    return sets, labels


def identify(docs: DataFrame, train: DataFrame, keep: list[str] | None = None, per_language: int = 300, landmarks: int = 32, most_landmarks: int = 1024, ridge: float = 1e-3) -> DataFrame:
    """``lang_pred, score`` of every row of ``docs``, beside its columns ``keep`` (doc_id); learned from ``train``'s text and lang.

    Bounds: ``per_language`` training texts and ``landmarks`` landmark texts of each language, ``most_landmarks`` in all.
    """
    sets, labels = training_sets(train, per_language)
    model = docs.sparkSession.sparkContext.broadcast(fit(sets, labels, max(1, min(landmarks, most_landmarks // max(1, len(set(labels))))), ridge))

    def prepare():
        import numpy as np

        m = model.value
        if not m:
            return lambda texts: (pa.array(["und"] * len(texts), pa.string()), pa.array(np.zeros(len(texts))))
        index = np.full(GRAMS, len(m["grams"]), np.int16 if len(m["grams"]) < 1 << 15 else np.int32)  # grams of no landmark fall in a column that is not used
        index[m["grams"]] = np.arange(len(m["grams"]))
        three, two, one = index[:ONE], index[ONE:TWO], index[TWO:]
        marks, width = m["marks"].T, len(m["grams"]) + 1
        most = max(1, DENSE // width)

        def values(texts):
            code, n = _codes(texts)
            row = np.repeat(np.arange(len(texts), dtype=np.int64) * width, n)
            held = np.zeros((len(texts), width), np.uint8)
            flat = held.ravel()
            for feature in (three[code], two[code & 0xFFFF], one[code & 0xFF]):
                np.put(flat, row + feature, 1)
            p = held[:, :-1].astype(np.float32)
            norm = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True, dtype=np.float64), 1))
            return (_exact((p @ marks) / norm / m["size"]) @ m["weights"]) / 2.0**32 + m["bias"]

        def compute(texts):
            out = np.vstack([values(texts[i : i + most]) for i in range(0, len(texts), most)])
            best = out.argmax(axis=1)
            told = [has_letter(t) for t in texts]
            score = np.where(told, np.clip((out[np.arange(len(best)), best] + 1) / 2, 0, 1), 0)
            return pa.array([m["langs"][b] if ok else "und" for b, ok in zip(best, told, strict=True)], pa.string()), pa.array(score)

        return compute

    read = doc_text(docs) if keep is None else docs
    return annotate(read, keep or ["doc_id"], "lang_pred string, score double", prepare, 2 << 20)


def accepted(found: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Rows whose language is known and whose score is at least ``least_score``."""
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    found = identify(docs, docs.where(fold_of("doc_id", 5) != 0))
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
