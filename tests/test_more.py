"""Extraction, repair, resolution and questions on small tables, nulls and empty tables included."""

from pyspark.sql import functions as F

from kgloom.operators import canonical, chunks, dedup, extraction, questions, resolution
from kgloom.operators import triplets as T
from kgloom.operators.components import connected_components, spread_join
from kgloom.operators.named import containing
from kgloom.sources import files
from tests.test_core import triplets

RESPONSE = """Sure: ```json
{"entities": [{"name": "Box", "type": "Product"}, {"name": "vol. 2", "type": "Volume"}, {"name": " ", "type": "Product"}, {"name": "UL LLC", "type": "org"}, {"name": "Box", "type": "Model"}],
 "relationships": [{"source": "box", "target": "Volume 2", "keywords": "Has-Volume; x"}, {"source": "Box", "target": "nobody", "keywords": ""}, {"source": "", "target": "Box"}]}
```"""


def responses(spark, *texts):
    return spark.createDataFrame([("p", "d", f"c{i}", t) for i, t in enumerate(texts)], "project_id string, document_id string, chunk_id string, response string")


def test_responses(spark):
    r = responses(spark, RESPONSE, None, "", "no json", '{"entities": [', '{"entities": null}')
    e = extraction.entities(r).orderBy("chunk_id", "pos").collect()
    assert [(x.chunk_id, x.name, x.entity_type) for x in e] == [("c0", "Box", "product"), ("c0", "Volume 2", "volume"), ("c0", "UL Solutions", "ul"), ("c0", "Box", "model")]
    rel = {x.pos: x for x in extraction.relationships(r).collect()}
    assert set(rel) == {0, 1} and rel[0].relationship == "has_volume" and rel[0].destination_type == "volume"
    assert rel[0].source_type == "entity" and rel[1].destination_node == "nobody"  # two entities are called Box
    assert extraction.entities(responses(spark).limit(0)).count() == 0
    more = extraction.entities(responses(spark, RESPONSE.replace("Box", "BOX").replace("vol. 2", "vol 3")))
    both = extraction.with_continuation(extraction.entities(responses(spark, RESPONSE)), more).collect()
    assert sorted(x.name for x in both) == ["Box", "Box", "UL Solutions", "Volume 2", "Volume 3"]


def test_sections_and_ranges(spark):
    s = responses(spark, '```json\n{"sections": ["One", {"text": " Two "}, "", {"text": ""}]}\n```', None, "[]")
    assert [(x.pos, x.text) for x in extraction.sections(s).collect()] == [(0, "One"), (1, "Two")]
    t = spark.createDataFrame([(1, 0, "a" * 5), (1, 1, "b" * 4), (1, 2, None), (1, 3, "c"), (2, 0, "x" * 30)], "document_id long, pos int, text string")
    got = sorted((x.document_id, x.text) for x in chunks.merge_sections(t, 11).collect())
    assert got == [(1, "aaaaa\n\nbbbb"), (1, "c"), (2, "x" * 30)]
    pages = spark.createDataFrame([(1, 1, "bbbb and more"), (1, 2, "other"), (2, 5, "x")], "document_id long, page_number int, text string")
    got = {(x.document_id, x.pos): (x.first_page, x.last_page) for x in chunks.page_ranges(t.where("text is not null"), pages).collect()}
    assert got[1, 1] == (1, 1) and got[1, 0] == (1, 2) and got[2, 0] == (5, 5)


def test_files(spark, tmp_path):
    mail = b"Subject: Hi\nFrom: a@example.org\nContent-Type: text/html\n\n<p>One</p><b> two </b>"
    r = files.email_pages(spark.createDataFrame([("a.eml", bytearray(mail)), ("b.eml", None)], "path string, content binary")).collect()
    assert r[0].text == "Subject: Hi\nFrom: a@example.org\n\nOne\ntwo" and r[1].text == "\n\n"
    t = spark.createDataFrame([("product", 'A "b", c', "contains", "component", "x\ny", " ", None)], ", ".join(f"{c} string" for c in files.TRIPLET_COLUMNS))
    files.write_triplets(t, str(tmp_path / "t"))
    got = files.read_triplets(spark, str(tmp_path / "t")).collect()
    assert [tuple(x) for x in got] == [("product", 'A "b", c', "contains", "component", "x\ny", None, None)]


def test_standards_and_targets(spark):
    names = ["IEC 62133-2", "iec 62133-2", "UL 62133-2", "UL/CSA 62133-2", "UL CSA/IEC 62133-2", "none"]
    d = spark.createDataFrame([("p", n) for n in names] + [("q", "UL 62133-2")], "project_id string, name string")
    got = {(x.project_id, x.name): x.canonical for x in dedup.standards(d).collect()}
    assert got["p", "iec 62133-2"] == got["p", "IEC 62133-2"] == "IEC 62133-2" and got["p", "UL 62133-2"] == "UL 62133-2"
    assert got["p", "UL/CSA 62133-2"] == "UL CSA/IEC 62133-2" and len(got) == 7
    x = spark.createDataFrame([("Air (13-inch, M4), Pro and Mini, pro, ,",), (None,), ("A (x, y",)], "raw string")
    assert [r[0] for r in x.select(dedup.target_names(F.col("raw"))).collect()] == [["Air (13-inch, M4)", "Pro", "Mini"], [], ["A (x, y"]]


def test_queries_of_targets_read_their_own_fixtures(spark, tmp_path):
    from kgloom.plans import repair

    part = [(k, "Box", "B1", "Steel", 5) for k in range(4)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {x.id: x.names for x in repair.prod_parse_targets(spark, str(tmp_path)).collect()}
    box = "Box (Steel, B1, 2025);B1"
    assert got == {0: f"{box};Steel", 1: box, 2: "Box (Steel, B1, 2025);B1 (x, Steel", 3: box}
    targets = {x.target: x.product for x in repair.prod_resolve_target(spark, str(tmp_path)).collect() if x.project_id == "run_0"}
    assert targets["b1"] == targets["Box"]


def test_repair(spark):
    t = triplets(
        spark,
        ("product", "Box", "has_model", "model", "Box One"),
        ("product", "Box", "contains", "component", "Lid"),
        ("product", "Box", "has_model", "model", "box"),
        ("product", "Tin", "contains", "component", "Cap"),
        ("model", "Big Tin 2", "contains", "component", "Nut"),
        ("product", "Far DVT1", "contains", "component", "Nut"),
    )
    assert {(r.product, r.model) for r in dedup.product_models(t).collect()} == {("Tin", "Big Tin 2")}
    rest = dedup.without_named_models(t)
    assert rest.count() == 5
    assert [tuple(r)[1:] for r in dedup.model_components(rest).collect()] == [("box one", "lid")]
    assert dedup.without_stages(t).count() == 5
    target = t.select("project_id").distinct().withColumn("name", F.lit("tin"))
    assert {r.source_node for r in dedup.within_reach(t, target).collect()} == {"Tin"}


def test_ingest_twice_is_once(spark):
    t = T.canonicalize(triplets(spark, ("applicant", "Acme Inc.", "has_product", "product", "Box"), ("product", "Box", "has_model", "model", "Box 1")))
    new = T.canonicalize(triplets(spark, ("applicant", "Acme Systems GmbH", "has_product", "product", "Box"), ("component", "Lid", "manufactured_by", "company", "Acme")))
    new = new.withColumn("document_id", F.lit("other"))
    docs = lambda x: x.select("document_id", F.concat(F.lit("h"), "document_id").alias("content_hash")).distinct()
    nodes = canonical.nodes(t).select("entity_type", "canonical_id", "name", "normalized_name", "aliases")
    found = {r.name: (r.canonical_id, r.decision) for r in resolution.resolve(canonical.ends(new).select("entity_type", "name").distinct(), nodes).collect()}
    assert found["Acme Systems GmbH"] == ("company_acme", "MATCHED_EXISTING") and found["Lid"][1] == "CREATED_NEW"
    n, e, k = resolution.ingest(new, docs(new), nodes, canonical.edges(t), docs(t))
    rows = lambda d: sorted((r.source_id, r.relationship, r.destination_id, r.evidence_count, r.document_ids) for r in d.collect())
    want = rows(e)
    assert ("company_acme", "HAS_PRODUCT", "product_box", 2) in [w[:4] for w in want] and len(want) == 3
    again = resolution.ingest(new, docs(new), n.withColumn("normalized_name", F.lower("name")), e, k)
    assert rows(again[1]) == want and again[2].count() == k.count() == 2


def test_questions(spark):
    q = spark.createDataFrame([(1, 'Which components and sections does "Box One" of Acme have?'), (2, None), (3, "")], "query_id long, query string")
    u = {r.query_id: r for r in questions.understood(q).collect()}
    assert u[1].intents == ["component", "clause"] and u[1].names[:1] == ["Box One"] and "Acme" in u[1].names
    assert u[2].intents == ["general_document_information"] and u[3].keywords == []
    assert {r.query_id: r.labels for r in questions.targets(q).collect()}[1] == ["Component", "Material", "Clause"]
    names = spark.createDataFrame([("a", "blue box"), ("b", "box"), ("c", "bo")], "id string, low string")
    got = {(r.id, r.text) for r in containing(spark.createDataFrame([("box",), ("b",), ("",), ("zz",)], "text string"), names).collect()}
    assert got == {("a", "box"), ("b", "box"), ("a", "b"), ("b", "b"), ("c", "b")}
    n = spark.createDataFrame([("x", "Blue Box", "product", None), ("y", "Box", "model", "a lid"), ("z", None, None, "")], "canonical_id string, name string, entity_type string, description string")
    best = questions.fuzzy_search(n, spark.createDataFrame([("BOX",), ("ld",)], "query string")).where("place = 1").collect()
    assert {(r.query, r.canonical_id) for r in best} == {("box", "y"), ("ld", "y")}


def test_large_components_are_spread(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, 51), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(star).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[51] == 50
    left = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    assert spread_join(left, right, "k", sizes, 33).count() == left.join(right, "k").count() == 67


def test_equivalent_children_of_one_parent_are_one(spark):
    rows = [("model", "m1", "Box One", ["B1"]), ("model", "m2", "BOX one", []), ("model", "m3", "Acme Box One", []), ("model", "m4", "Box One", []), ("model", "m5", "Lid", []), ("model", "m6", "", []), ("product", "p", "P", []), ("product", "q", "Q", [])]
    nodes = spark.createDataFrame(rows, "entity_type string, canonical_id string, name string, aliases array<string>")
    edges = [("p", "HAS_MODEL", m) for m in ("m1", "m2", "m3", "m5", "m6")] + [("q", "HAS_MODEL", "m4"), ("m1", "CONTAINS", "c"), ("m2", "CONTAINS", "c"), ("m2", "LIKE", "m1"), ("m4", "CONTAINS", "c")]
    n, e = resolution.collapse_under_parent(nodes, spark.createDataFrame(edges, "source_id string, relationship string, destination_id string"), "model", "HAS_MODEL")
    got = {r.canonical_id: (r.name, r.aliases) for r in n.collect()}
    assert got["m3"] == ("Acme Box One", ["B1", "BOX one", "Box One"]) and got["m4"] == ("Box One", []) and set(got) == {"m3", "m4", "m5", "m6", "p", "q"}
    assert sorted(map(tuple, e.collect())) == [("m3", "CONTAINS", "c"), ("m4", "CONTAINS", "c"), ("p", "HAS_MODEL", "m3"), ("p", "HAS_MODEL", "m5"), ("p", "HAS_MODEL", "m6"), ("q", "HAS_MODEL", "m4")]
