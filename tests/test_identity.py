"""Variants of names, merged texts, understood questions and depths against plain code and fixed cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.operators import chunks, dedup, graph, products, questions, variants


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault((r.project_id, r.canonical), set()).add(getattr(r, key))
    return sorted(map(sorted, out.values()))


def test_five_battery_names_are_two_components(spark):
    names = ["Battery BP-EA565ABY", "BP-EA565ABY cell", "Li-ion Battery BP-EA565ABY", "Battery pack", "battery packs"]
    rows = [("p", i, n, "", None, 9) for i, n in enumerate(names)] + [("q", 7, "Battery pack", "", None, 9), ("p", 8, "Glass", "", None, 9), ("p", 9, " ", "", None, 9)]
    got = variants.component_variants(spark.createDataFrame(rows, "project_id string, seq long, name string, evidence string, component_description string, parts int")).collect()
    assert groups(got, "name") == [["BP-EA565ABY cell", "Battery BP-EA565ABY", "Li-ion Battery BP-EA565ABY"], ["Battery pack"], ["Battery pack", "battery packs"], ["Glass"]]
    # "Li-ion" is no part number, as it has no digit; most words win among readable names
    assert {r.canonical for r in got if "BP" in r.name} == {"Li-ion Battery BP-EA565ABY"}


def test_part_numbers_and_singulars(spark):
    df = spark.createDataFrame([("see ab-12/3x, AB-12/3X and IEC-60950 or UL-1",), ("no-digits here",), ("",)], "t string")
    assert [r[0] for r in df.select(variants.part_numbers(F.col("t"))).collect()] == [["AB-12/3X"], [], []]
    words = ["main batteries", "boxes", "glass", "fuses", "bus", "caps", "its", "ties", "two keys"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(variants.singular(F.col("t"))).collect()
    assert [r[0] for r in got] == ["main battery", "box", "glass", "fuse", "bus", "cap", "its", "tie", "two key"]


def test_models(spark):
    names = ["Galaxy A56", "galaxy  a56", "Galaxy A56 5G", "Galaxy A56 Pro", "Galaxy A56 2021", "Galaxy A56 2022 5G", "A56", "Orbit X1", "Orbit X1 Black", "X1 Orbit"]
    models = spark.createDataFrame([("p", i, n) for i, n in enumerate(names)] + [("q", 1, "Galaxy A56")], "project_id string, seq long, name string")
    t = spark.createDataFrame([("p", "Product", "Orb", "has model", "model", "Orbit X1"), ("p", "product", "Other", "has_model", "model", "Orbit X1 Black")], "project_id string, source_type string, source_node string, relationship string, destination_type string, destination_node string")
    got = groups(variants.model_variants(models, t).collect(), "name")
    # years differ, but either agrees with the name without one, and equivalence is transitive
    assert ["Galaxy A56", "Galaxy A56 2021", "Galaxy A56 2022 5G", "Galaxy A56 5G", "galaxy  a56"] in got
    assert ["Galaxy A56 Pro"] in got and ["A56"] in got and ["Galaxy A56"] in got
    # products of two are known and differ; a name without one joins both
    assert ["Orbit X1", "Orbit X1 Black", "X1 Orbit"] in got


def test_contained_sets(spark):
    r = random.Random(1)
    sets = {i: sorted({r.choice("abcdefghij") for _ in range(r.randint(1, 6))}) for i in range(80)}
    got = variants.contained(spark.createDataFrame([("g", i, s) for i, s in sets.items()], "g string, id int, x array<string>"), ["g"], "x").collect()
    assert sorted((x.small, x.large) for x in got) == sorted((a, b) for a, b in itertools.permutations(sets, 2) if len(sets[a]) >= 2 and set(sets[a]) <= set(sets[b]))


def test_a_standard_of_forty_bodies(spark):
    body = [a + b for a in "abcdefg" for b in "pqrstu"][:40]
    names = [" ".join(body) + " 123", " ".join(body[:3]) + " 123", body[0] + " 123", " ".join(body) + " 124"]
    got = groups(dedup.standards(spark.createDataFrame([("p", n) for n in names], "project_id string, name string")).collect(), "name")
    assert got == sorted([sorted(names[:2]), [names[2]], [names[3]]])


def test_merged_descriptions(spark):
    long = "This component is a rechargeable lithium-ion battery pack used in the mobile phone model."
    rows = [("a", 1, long), ("a", 2, "Battery pack in the model."), ("b", 1, "One sentence. Another."), ("b", 2, ""), ("c", 1, None), ("c", 2, "First. Second."), ("d", 1, "Same size."), ("d", 2, "Size same."), ("e", 1, None)]
    got = dedup.merged_texts(spark.createDataFrame(rows, "k string, seq long, description string"), ["k"], "description", []).collect()
    assert {r.k: r.description for r in got} == {"a": "Battery pack in the model.", "b": "One sentence. Another.", "c": "First.", "d": "Size same.", "e": ""}


def test_short_descriptions(spark):
    cases = {
        "Samsung is the main client company for the UL project. The document also lists many unrelated compliance details.": "Samsung is the main client company for the UL project.",
        "Long copied regulatory excerpt about battery safety requirements and thermal runaway testing conditions | Battery component.": "Battery component.",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.short_description(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_understood_questions(spark):
    asked = [
        (1, "what is the relationship between the battery and the fuse for this charger"), (2, 'Show clauses of "Galaxy  A56" and Galaxy A56, please'), (3, None), (4, "12 34 x the"),
        (5, "Which tests are required, and what produces heat?"),
    ]
    got = {r.query_id: r for r in questions.understood(spark.createDataFrame(asked, "query_id long, query string")).collect()}
    assert (got[1].intents, got[1].names, got[1].keywords) == (["relationships"], [], ["battery", "fuse", "charger"])
    assert got[2].names[0] == "Galaxy A56" and [x.lower() for x in got[2].keywords].count("galaxy a56") == 1 and got[2].intents == ["clause"]
    assert got[3].intents == got[4].intents == ["general_document_information"] and got[4].keywords == []
    assert got[5].intents == ["test", "relationships", "compliance"] and got[5].keywords == ["heat"]
    targets = questions.targets(spark.createDataFrame([(1, "What standards apply to this model?"), (2, "nothing")], "query_id long, query string")).collect()
    assert "Standard" in targets[0].labels and "COMPLIES_WITH" in targets[0].relations and targets[1].labels == targets[1].relations == []


@pytest.mark.parametrize("n", [60])
def test_depths(spark, n):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(n)] + [("n000", "n003"), ("x", "y"), ("y", "x"), ("y", "z"), ("w", "w"), ("w", "n060")]
    got = {r.id: r.depth for r in graph.depths(spark.createDataFrame(edges, "source_id string, destination_id string")).collect()}
    assert got == {f"n{i:03}": i for i in range(n + 1)} | {"x": None, "y": None, "z": None, "w": 0}


def test_page_ranges_against_plain_code(spark):
    r = random.Random(7)
    make = lambda n: " ".join(r.choice("red Blue green sea  of fox ox".split(" ")) for _ in range(n))
    sections = [(d, p, make(r.randint(1, 9))) for d in range(8) for p in range(6)]
    pages = [(d, p, make(r.randint(0, 5)) if r.random() > 0.1 else None) for d in range(7) for p in range(1, 8)]
    low = lambda t: " ".join((t or "").lower().split())
    expected = {}
    for d, p, s in sections:
        s, fits, every = low(s), [], []
        for e, n, t in pages:
            t = low(t)
            if e == d and t:
                every.append(n)
                if t in s or s in t or len(set(t.split()) & set(s.split())) / len(set(t.split())) >= 0.45:
                    fits.append(n)
        if every:
            expected[d, p] = min(fits or every), max(fits or every)
    got = chunks.page_ranges(spark.createDataFrame(sections, "document_id long, pos int, text string"), spark.createDataFrame(pages, "document_id long, page_number int, text string"))
    assert {(x.document_id, x.pos): (x.first_page, x.last_page) for x in got.collect()} == expected


def test_resolved_targets(spark):
    rows = [
        ("p", 1, "iPhone 16", ["phone"], "iphone_16_manual.pdf"), ("p", 2, "iPhone 16 Pro", None, None), ("p", 3, "MacBook Air (13-inch, M4, 2025)", ["MacBook Air", ""], "mba.pdf"), ("p", 4, "Air", [], ""),
        ("p", 5, "Galaxy Tab", [], "sm_x200_report.v2.pdf"), ("q", 1, "Other", [], None), ("p", 6, " ", ["blank"], None), ("p", 7, "IPHONE 16", [], None),
    ]
    products_ = spark.createDataFrame(rows, "project_id string, seq long, name string, aliases array<string>, source_file string")
    asked = ["iPhone 16", "iphone-16", "iPhone 16 Pro Max", "MacBook Air", "macbook", "sm x200", "nothing", "16 pro", "", None, "blank", "the iphone 16"]
    got = {r.target: r.product for r in products.resolved_targets(products_, spark.createDataFrame([("p", a) for a in asked], "project_id string, target string")).collect()}
    assert got == {
        "iPhone 16": "iPhone 16", "iphone-16": "iPhone 16", "iPhone 16 Pro Max": "iPhone 16 Pro", "MacBook Air": "MacBook Air (13-inch, M4, 2025)", "macbook": "MacBook Air (13-inch, M4, 2025)",
        "sm x200": "Galaxy Tab", "nothing": None, "16 pro": "iPhone 16 Pro", "blank": None, "the iphone 16": "iPhone 16",
    }
