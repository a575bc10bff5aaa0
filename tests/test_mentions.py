"""Firms that texts name, and roles, by cases worked out by hand and against a plain search."""

import random

from pyspark.sql import functions as F

from kgloom.operators import mentions as M

CHUNK = "project_id string, document_id string, chunk_id string, seq long, source_file string, text string, extra string"
ENTITY = "project_id string, seq long, name string, entity_type string, description string, kinds array<string>"
TRIPLET = "project_id string, seq long, source_type string, source_node string, relationship string, destination_type string, destination_node string, description string"


def chunks(spark, *texts):
    return spark.createDataFrame([(p, "d", f"c{i}", i, f"f{i % 2}.pdf", t, "x") for i, (p, t) in enumerate(texts)], CHUNK)


def test_spellings_of_a_firm_are_one_mention(spark):
    text = "Copyright © 2026 Contoso Inc. All rights reserved. Testing conducted by Contoso in August 2024 using Widget 16 units. Contoso products comply with the listed standards. Widget 16 - Tech Specs - Contoso Support (IN)"
    rows = M.company_mentions(chunks(spark, ("p", text), ("p", "Copyright © 2026 UL Solutions. All rights reserved."), ("p", "USB-C Connector\n Support\n New Zealand. Support\n Contents"), ("p", None), ("p", ""), ("p", "Our products. Copyright UN 38. Copyright Safety."))).collect()
    assert [(r.chunk_id, r.name, r.key) for r in rows] == [("c0", "Contoso Inc", "contoso")]
    assert rows[0].kinds == ["copyright", "testing_by", "products", "support"]
    # the shorter evidence is in a longer one only where it was joined later
    assert rows[0].evidence == "Copyright © 2026 Contoso Inc | Testing conducted by Contoso | Contoso products | Contoso Support ("


def test_a_name_with_a_legal_form_wins(spark):
    rows = M.company_mentions(chunks(spark, ("p", "Copyright © 2026 Contoso Inc. All rights reserved. Testing conducted by CONTOSO INC."), ("p", "Acme products, Acme Ltd products, ACME products"))).collect()
    assert {r.chunk_id: (r.name, r.kinds) for r in rows} == {"c0": ("Contoso Inc", ["copyright", "testing_by"]), "c1": ("Acme Ltd", ["products"])}


def test_mentions_go_into_entities(spark):
    m = M.company_mentions(chunks(spark, ("p", "Acme Ltd products."), ("p", "Copyright Globex. Acme products."), ("q", "Acme products."), (None, "Copyright Globex.")))
    own = [("p", 1, "Acme", "brand", "A maker of things and other things.", ["seen"]), ("p", 2, "ACME", "company", "Later.", None), ("p", 3, "Acme", "product", "Not a firm.", None), ("q", 4, "Other", "company", "", None)]
    got = {(r.project_id, r.seq, r.name, r.entity_type, r.description): r.kinds for r in M.merged_mentions(m, spark.createDataFrame(own, ENTITY)).collect()}
    assert got == {
        ("p", 1, "Acme Ltd", "brand", "Acme products"): ["seen", "products"], ("p", 2, "ACME", "company", "Later."): None, ("p", 3, "Acme", "product", "Not a firm."): None, ("q", 4, "Other", "company", ""): None,
        ("p", None, "Globex", "company", "Copyright Globex"): ["copyright"], ("q", None, "Acme", "company", "Acme products"): ["products"], ("", None, "Globex", "company", "Copyright Globex"): ["copyright"],
    }
    assert {tuple(r) for r in M.mention_files(m).collect()} == {("p", "acme", "f0.pdf"), ("p", "acme", "f1.pdf"), ("p", "globex", "f1.pdf"), ("q", "acme", "f0.pdf"), ("", "globex", "f1.pdf")}


def test_roles(spark):
    c = chunks(spark, ("p", "Made for Acme-Works of Rome."), ("p", "Applicant: Globex Corp."), ("q", "manufactured by acme works"), ("p", "Initech is here."))
    own = [("p", 1, "Acme Works Ltd", "Applicant", "", None), ("p", 2, "Globex", "applicant", "", None), ("p", 3, "Unseen", "applicant", "", None), ("p", 4, "Initech Inc", "applicant", "", ["products"]), ("q", 5, "Acme Works", "applicant", "", ["demoted_applicant"]), ("p", 6, "Inc", "applicant", "", None)]
    t = [("p", 1, "ul", "UL", "Has Applicant", "applicant", "ACME works", ""), ("p", 2, "ul", "UL", "has_applicant", "applicant", "Globex", ""), ("p", 3, "Applicant", "Acme Works", "has_product", "product", "X", ""), ("p", 4, "company", "Acme Works", "has_product", "product", None, ""), (None, 5, "ul", "UL", "has_applicant", "applicant", "acme works", "")]
    e, left = M.demoted_applicants(c, spark.createDataFrame(own, ENTITY), spark.createDataFrame(t, TRIPLET))
    assert {r.seq: (r.entity_type, r.kinds) for r in e.collect()} == {1: ("company", ["demoted_applicant"]), 2: ("applicant", []), 3: ("applicant", []), 4: ("applicant", ["products"]), 5: ("company", ["demoted_applicant"]), 6: ("applicant", [])}
    assert {r.seq: r.source_type for r in left.collect()} == {2: "ul", 3: "company", 4: "company", 5: "ul"}
    made = [("p", 1, "component", "Cell", "manufactured_by", "company", "Acme Works", ""), ("p", 2, "component", "Cell", "manufactured_by", "company", "Acme Works", "Manufactured  by Acme"), ("q", 3, "component", "Cell", "party_role_manufacturer", "company", "Acme Works", None), ("p", 4, "component", "Cell", "manufactured_by", "company", "Nobody", ""), ("p", 5, "component", "Cell", "has_part", "company", "Acme Works", "")]
    assert sorted(r.seq for r in M.without_unspoken_manufacturers(c, spark.createDataFrame(made, TRIPLET)).collect()) == [2, 3, 4, 5]
    empty = spark.createDataFrame([], CHUNK)
    assert M.company_mentions(empty).count() == 0
    assert M.without_unspoken_manufacturers(empty, spark.createDataFrame(made, TRIPLET)).count() == 5


def test_texts_that_name_cores(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    texts = [(p, f"{p}{i}", " ".join(word() for _ in range(r.randint(0, 12)))) for p in "pq" for i in range(60)]
    # one text of many characters, none of them plain
    texts.append(("p", "long", "é" * 50_000 + " ab ba " + "é b " * 50_000))
    cores = list({(p, " ".join(word() for _ in range(r.randint(1, 3)))) for p in "pq" for _ in range(40)}) + [("p", ""), ("p", "éé ab")]
    got = M.chunks_naming(spark.createDataFrame(texts, "project_id string, id string, low string"), spark.createDataFrame(cores, "project_id string, core string"))
    assert sorted(tuple(x) for x in got.select("project_id", "id", "core").collect()) == sorted((p, i, c) for p, i, t in texts for q, c in set(cores) if p == q and c and c in t)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert got.where(F.col("id") == "long").count() > 0
