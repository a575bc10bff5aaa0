"""Suffix-array removal, collocations and hard negatives against plain code."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from kgloom.llm import bloom, collocations, hard_negatives, suffix_arrays
from kgloom.llm.queries import QUERIES

R = random.Random(11)


def words(n, kinds=40):
    return " ".join(f"w{R.randint(0, kinds)}{'ö' * (R.random() < 0.1)}" for _ in range(n))


PASSAGE = words(60)
LONG = words(90_000)
TEXTS = [
    (1, None), (2, ""), (3, "short"), (None, PASSAGE + " end"), (5, words(80) + PASSAGE + words(40)), (5, PASSAGE[:210]), (6, "ab" * 300), (7, "ab" * 300 + "c"),
    (8, " " * 700 + "x"), (9, words(200)), (10, words(200)), (11, LONG), (12, "other " + LONG[200:]), (13, words(30) + " " + LONG[400_000:400_400]), (14, words(30, 9000)),
]
TEXTS += [TEXTS[9], TEXTS[9], (15, "a" * 199), (16, "a" * 199), (17, "bb" + "a" * 200), (18, "a" * 200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "spans", "kept", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, removed string, kept string, h1 int").repartition(3)


@pytest.mark.parametrize("hot", [1 << 14, 1])
def test_repeats(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_arrays, "HOT", hot)
    seen = collections.Counter(hashlib.md5(b[i : i + 200]).digest() for _, t in TEXTS for b in [(t or "").encode()] for i in range(len(b) - 199))
    expected = collections.Counter()
    for d, t in TEXTS:
        b, spans = (t or "").encode(), []
        for i in range(len(b) - 199):
            if seen[hashlib.md5(b[i : i + 200]).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        kept = b"".join(b[p:q] for p, q in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(b)], strict=True))
        expected[d, len(b), tuple(map(tuple, spans)), kept] += 1
    got = suffix_arrays.without_repeats(docs, ["doc_id"]).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in got) == expected


def test_repeats_of_nothing(docs):
    assert suffix_arrays.without_repeats(docs.where("doc_id < 0"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh ", bytes(range(256))])
def test_two_stage_sorting(letters):
    r = random.Random(3)
    for n in (1, 2, 50, 700):
        x = bytes(r.choice(letters) for _ in range(n)) + bytes([letters[0]]) * (n // 3)
        a = np.frombuffer(x, np.uint8)
        order = suffix_arrays.two_stage_order(a, np.ones(len(a), bool), len(a)).tolist()
        assert order == sorted(range(len(x)), key=lambda i: x[i:])
        shared = suffix_arrays.common_prefixes(a, np.array(order), 20)
        plain = [next((k for k in range(20) if x[i + k : i + k + 1] != x[j + k : j + k + 1] or i + k >= len(x)), 20) for i, j in zip(order, order[1:], strict=False)]
        assert shared.tolist() == plain


def test_bloom(spark):
    keys = [R.getrandbits(64) - (1 << 63) for _ in range(5000)]
    found = bloom.bloom(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert bloom.holds(found, np.array(keys)).all()
    assert bloom.holds(found, np.array([R.getrandbits(64) - (1 << 63) for _ in range(5000)])).mean() < 0.05
    assert bloom.holds(bloom.bloom(spark.createDataFrame(keys, "long").toDF("key"), 16), np.array(keys)).all()


def plain_collocations(rows, least, most):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = []
        for p, a in c.items():
            if len(p) < 2 or a < least or any(len(q) > len(p) and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for q, b in c.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def test_collocations(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice(["Red", "blue ", "sea", "Ünd", "of", "a\x00b", "q"]) + r.choice([" ", "  ", "\t", ". ", "\n", ",", " "]) for _ in range(n))
    rows = [(r.choice(["en", "de", None, ""]), make(60)) for _ in range(30)] + [("en", None), ("en", ""), ("fr", " .. ,"), (None, "one"), ("en", make(30_000))]
    rows += rows[:3]
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "lang string, text string, n int, phrase string").repartition(4)
    for least, most in ((3, 2000), (2, 5)):
        got = collocations.strongest(collocations.collocations(df, least), most).collect()
        assert sorted(map(tuple, got)) == plain_collocations(rows, least, most)
    assert collocations.strongest(collocations.collocations(df.where("n > 1"))).count() == 0


def test_score_is_exact(spark):
    a = 4_000_000_000_000_001
    df = spark.createDataFrame([(a, a, a + 3), (10, 10, 10), (10, 999_999_937, 1_000_003)], "a long, l long, r long")
    assert [r[0] for r in df.select(collocations.score("a", "l", "r")).collect()] == [1_000_000 * a * a // (a * (a + 3)), 1_000_000, 0]


def test_collocations_in_small_deliveries(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_TOKENS", 50)
    rows = [("en", "the red sea, the red sea. the red fox") for _ in range(20)]
    got = collocations.strongest(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 10, 2000)


def plain_negatives(rows, k=5):
    seen = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(v)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    q = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in seen]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v in q:
        if i % 100:
            continue
        s = sorted((-dot(v, w), j, z) for j, z, w in q if j != i)
        for p, j in [(-p, j) for p, j, z in s if z == y][:k]:
            inside = [(-n, m) for n, m, z in s if z != y and 80 * p <= -100 * n <= 100 * p][:k]
            out += [(i, j, at + 1, m, p, n) for at, (n, m) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e6])
def test_hard_negatives(spark, spread):
    r = np.random.default_rng(4)
    centres = r.normal(size=(4, 6))
    rows = [(i * 20, (centres[i % 4] + spread * r.normal(size=6)).tolist(), int(r.integers(0, 3))) for i in range(150)]
    rows += rows[:10] + [(9000, rows[0][1], 1), (9100, rows[0][1], 2), (7, [1.0, 2.0], 1), (8, [], 1), (None, rows[0][1], 1), (3, None, 1), (4, rows[0][1], None), (11, [1.0, None], 1), (12, [float("nan")], 1), (13, [float("inf")], 1), (0, [-0.0] * 6, 5), (700, rows[1][1], 1)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, embedding array<double>, label int, block string, key int")
    label = "label"
    from pyspark.sql import functions as F

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    for chunk in (32 << 20, 50_000):
        hard_negatives.CHUNK_BYTES, old = chunk, hard_negatives.CHUNK_BYTES
        try:
            got = hard_negatives.hard_negatives(df, "vec_id % 100 = 0", relabel=moved).collect()
        finally:
            hard_negatives.CHUNK_BYTES = old
        assert sorted(map(tuple, got)) == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.where("vec_id < 0"), "vec_id % 100 = 0").count() == 0


def test_bounds_spare_products(monkeypatch):
    """Close anchors leave most candidates to their bounds."""
    r = np.random.default_rng(0)
    x, scored = 256 * r.normal(size=(1, 32)) + np.round(r.normal(size=(60, 32))), 0
    x, q = np.floor(x), np.floor(256 * r.normal(size=(4000, 32)))
    exact = hard_negatives.products

    def counted(rows, y):
        nonlocal scored
        scored += len(rows)
        return exact(rows, y)

    monkeypatch.setattr(hard_negatives, "products", counted)
    label = np.arange(4000) % 5
    anchors = {"key": list(range(60)), "vec_id": -1 - np.arange(60), "label": np.zeros(60, np.int64)}
    found = hard_negatives._Positives(anchors, 5)
    hard_negatives._walk(q, np.linalg.norm(q, axis=1), x, found.over(np.arange(4000), label))
    for key in range(60):
        s = exact(q, x[key])
        plain = sorted((-int(v), i) for i, v in enumerate(s.tolist()) if label[i] == 0)[:5]
        assert [(-s, i) for k, i, s in found.rows() if k == key] == plain
    assert scored < 0.3 * 60 * 4000


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op11_suffix_array_dedup"](spark, sf)
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert QUERIES["op13_hard_negatives"](spark, sf).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
