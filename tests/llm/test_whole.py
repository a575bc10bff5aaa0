"""Nothing is left out above bounds that the given tables don't reach."""

import random

import pytest
from test_operators import TEXTS, plain_ppm

from kgloom.llm import decontaminate, language_id, licenses, line_dedup, lm_scoring, packing, secrets


def test_lm_scores_keep_rare_strings(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MOST_GRAMS", 500, raising=False)
    monkeypatch.setattr(lm_scoring, "TRIE_GRAMS", 300, raising=False)
    monkeypatch.setattr(lm_scoring, "PASS_GRAMS", 400, raising=False)
    docs = spark.createDataFrame([*TEXTS.items(), (3, TEXTS[3])], "doc_id long, text string").repartition(3)
    train = docs.where("doc_id not in (3, 6, 10)")
    texts = [TEXTS[i] for i in TEXTS if i not in (3, 6, 10)]
    rows = lm_scoring.lm_scores(docs, train).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r.doc_id != 6:
            assert r.score == pytest.approx(plain_ppm(texts, TEXTS[r.doc_id]), rel=1e-4, abs=1e-3)


def test_line_dedup_compares_short_lines(spark):
    seven, eight = "one two three four five six seven", "one two three four five six seven eight"
    texts = {1: f"Home\n\n{seven}\nHome", 2: f"home \n \n{seven} x\n{eight}", 3: f"contact\nhome page\n{seven.replace('two', 'too')}\n{eight.replace('two', 'too')}", 4: f"\nHome  page\n{seven.upper()}", 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line, r.distance) for r in line_dedup.duplicate_lines(docs).collect()}
    # the line of eight words in 2 is within one word of "seven x", which has eight too, and starts the chain that goes on in 3
    assert got == {(1, 3): (1, 0, 0), (2, 0): (1, 0, 0), (2, 3): (2, 2, 1), (3, 3): (2, 2, 1), (4, 1): (3, 1, 0), (4, 2): (1, 2, 0)}
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert cleaned[1] == f"Home\n\n{seven}" and cleaned[2] == f" \n{seven} x" and cleaned[4] == "" and cleaned[5] == ""


def test_line_dedup_finds_passages_in_other_lines(spark):
    r = random.Random(4)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage, chain = words(70), words(12)
    changed = [*chain[:3], "x", *chain[4:]]
    texts = [
        (1, " ".join([*words(20), *passage, *words(15)])),
        (2, "Own line of document two\n" + "  ".join([*words(33), *passage, *words(9)])),
        (3, " ".join(words(90))),
        (4, " ".join(chain)),
        (5, " ".join(changed)),
        (6, " ".join([*changed[:7], "y", *changed[8:]])),
        (7, "one id, two texts"),
        (7, "only here"),
        (8, "one id, two texts"),
        (None, "one id, two texts"),
    ]
    docs = spark.createDataFrame([(i, t, 3, 4) for i, t in texts], "doc_id long, text string, gone int, units int").repartition(3)
    found = line_dedup.duplicate_lines(docs).collect()
    assert {f.doc_id for f in found} == {2, 5, 6, 8}
    assert {(f.doc_id, f.kept_doc_id, f.distance) for f in found if f.doc_id in (5, 6)} == {(5, 4, 1), (6, 4, 1)}
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = [(x.doc_id, x.text) for x in out.collect()]
    assert (7, "only here") in rows and (8, "") in rows and (None, "one id, two texts") in rows and (3, texts[2][1]) in rows
    two = dict(rows)[2]
    assert two.startswith("Own line of document two\n") and len(two.split()) < 5 + 33 + 9 + 70 - 16
    assert set(two.split("\n")[1].split()) <= set(texts[1][1].split())


def test_language_does_not_depend_on_neighbours(spark, monkeypatch):
    r = random.Random(2)
    words = {g: ["".join(r.choice(abc) for _ in range(r.randint(2, 7))) for _ in range(60)] for g, abc in (("x", "abcde"), ("y", "defgh"), ("z", "ghijk"))}
    rows = [(i, " ".join(r.choice(words[g]) for _ in range(r.choice((1, 1, 4, 40)))), g) for i, g in enumerate("xyz" * 70)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    for t, dense in ((table, 1 << 24), (table.orderBy("text").repartition(7), 1 << 24), (table.orderBy(table.doc_id.desc()).coalesce(1), 2000)):
        monkeypatch.setattr(language_id, "DENSE", dense)
        seen.append(sorted(map(tuple, language_id.identify(t, t.where("doc_id % 3 < 2 or doc_id % 5 = 0")).collect())))
    assert seen[0] == seen[1] == seen[2]
    kept = language_id.identify(table, table, table.columns).collect()
    assert sorted((k.doc_id, k.text, k.lang) for k in kept) == sorted(rows)


def test_long_candidates_are_seen_whole():
    assert {i for a, b in secrets.views_of(5, 305) for i in range(a, b)} == set(range(5, 305))
    assert secrets.views_of(5, 69) == [(5, 69)] and secrets.views_of(5, 9) == [(5, 9)]
    text = "x password: abcdefgh/A1b2C3d4E5f6G7h8! postgres://bob:Zx9kq7Lm2P@db well-known-words 1234567890123456"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["password: abcdefgh/A1b2C3d4E5f6G7h8"]
    assert [text[a:b] for a, b in secrets.candidates(text, base)] == ["Zx9kq7Lm2P"]
    token = "q" * 30 + "deadbeef" * 3 + "Z9" * 40
    base = secrets.base_spans(token)
    assert [token[a:b] for a, b in secrets.candidates(token, base)] == ["q" * 30, "Z9" * 40]


def test_licenses_by_many_templates(spark):
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(900)]
    templates = [("t%d" % i, " ".join(r.sample(vocabulary, r.randint(5, 30)))) for i in range(500)]
    texts = []
    for i in range(60):
        w = r.choice(templates)[1].split()
        r.shuffle(w)
        texts.append((i, "some words\n\n" + " ".join(w[: int(len(w) * r.choice((0.7, 0.81, 1.0)) + 0.999)]) + "\n\nw1 w2"))
    table = spark.createDataFrame(templates, "label string, text string")
    got = licenses.find_licenses(spark.createDataFrame(texts, "doc_id long, text string"), table).collect()
    for x in got:
        want = set()
        for block in dict(texts)[x.doc_id].split("\n\n"):
            held = set(block.split())
            want |= {label for label, t in templates if len(held & set(t.split())) >= 0.8 * len(t.split())}
        assert {f["label"] for f in x.found or []} == want
    assert sum(bool(x.found) for x in got) > 30


def test_placement_rule_against_plain_search():
    r = random.Random(6)
    for frugal in (True, False):
        lengths = [r.randint(1, 40) for _ in range(300)]
        bins: list[int] = []
        for s, (b, offset) in zip(lengths, packing.sum_of_squares(lengths, 50, frugal), strict=True):
            cost = lambda fills: sum([50 - f for f in fills].count(g) ** 2 for g in range(1, 50))
            open_bins = [i for i, f in enumerate(bins) if f + s <= 50]
            tries = [(cost([*bins[:i], bins[i] + s, *bins[i + 1 :]]), 50 - bins[i]) for i in open_bins]
            new = cost([*bins, s])
            assert (b < len(bins)) == (bool(tries) and (frugal or min(tries)[0] <= new))
            if b == len(bins):
                bins.append(0)
            else:
                assert (cost([*bins[:b], bins[b] + s, *bins[b + 1 :]]), 50 - bins[b]) == min(tries)
            assert bins[b] == offset
            bins[b] += s


def test_parts_of_a_benchmark_give_the_same(spark):
    r = random.Random(1)
    words = ["v%d" % i for i in range(40)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((3, 14, 30))))) for i in range(30)]
    docs = [(i, "é " + " ".join([*(r.choice(words) for _ in range(20)), *r.choice(items)[1].split(), *r.choice(items)[1].split()])) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.contamination(d, b, shard_bytes=n).collect())) for n in (1 << 20, 300))
    assert one == many and all(x[2] > 0 for x in one)
