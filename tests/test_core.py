from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.operators import canonical, chunks, graph
from kgloom.operators import triplets as T
from kgloom.operators.components import connected_components

COLUMNS = "project_id string, document_id string, seq long, source_type string, source_node string, relationship string, destination_type string, destination_node string, description string, keywords string"


def triplets(spark, *rows):
    full = [("p", "d1", i, *r, "", "") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).head().x


def test_standards_have_one_key(spark):
    for name in ("IEC 61010-1", "IEC 61010 1", "IEC61010-1"):
        assert value(spark, N.norm_standard(F.col("n")), n=name) == "iec 61010 1"
        assert value(spark, N.canonical_id(F.lit("standard"), F.col("n")), n=name) == "standard_iec_61010_1"


def test_equivalent_names(spark):
    same = [("Contoso", "Contoso Electronics Co., Ltd."), ("Global commercial office", "AEMS Global Commercial Office"), ("Acme", "acme inc.")]
    other = [("Contoso Electronics", "Contoso Display"), ("United", "United Technologies"), ("iPhone 16", "iPhone 16 Plus"), ("Acme", ""), ("Acme", "Acme Support")]
    for a, b in same + other:
        assert value(spark, N.names_equivalent(F.col("a"), F.col("b")), a=a, b=b) == ((a, b) in same), (a, b)


def test_norm_key_keeps_the_space_of_dropped_marks(spark):
    assert value(spark, N.norm_key(F.col("n")), n="A & B") == "a  b"
    assert value(spark, N.norm_entity(F.col("n")), n="A & B") == "a b"


def test_verdicts(spark):
    t = triplets(
        spark,
        ("applicant", "Acme", "produces", "product", "Box"),
        ("model", "Box 1", "has_model", "product", "Box"),
        ("product", "Box", "related", "model", "Box 2"),
        ("company", "Acme", "supplies", "product", "Box"),
        ("company", "Acme", "serves", "applicant", "Bolt"),
        ("company", "", "has_product", "product", "Box"),
    )
    got = {r.seq: (r.verdict, r.source_node, r.relationship) for r in T.judge(t).collect()}
    assert got[0] == ("kept", "Acme", "has_product")
    assert got[1] == ("flipped", "Box", "has_model")
    assert got[2] == ("defaulted", "Box", "has_model")
    assert [got[i][0] for i in (3, 4, 5)] == ["not allowed", "serves", "empty name"]


def test_suppliers_go_to_the_owner(spark):
    t = triplets(
        spark,
        ("applicant", "Acme", "has_product", "product", "Box"),
        ("product", "Box", "has_model", "model", "Box 1"),
        ("model", "Box 1", "contains", "component", "Fan"),
        ("component", "Fan", "supplied_by", "company", "Fanco"),
        ("component", "Fan", "party_role_manufacturer", "company", "Makeco"),
    )
    got = {(r.source_node, r.destination_node) for r in T.suppliers(t).collect()}
    assert got == {("Fanco", "Acme"), ("Makeco", "Acme")}


def test_enforced_triplets_are_allowed_and_stable(spark):
    t = triplets(
        spark,
        ("applicant", "Acme", "has_product", "product", "Box"),
        ("product", "Box", "has_model", "model", "Box 1"),
        ("product", "Box", "contains", "component", "Fan"),
        ("component", "Fan", "complies_with", "standard", "IEC 1"),
        ("component", "Fan", "has_certification", "certification", "CB"),
    )
    once = T.enforce(t)
    rows = {(r.source_node, r.relationship, r.destination_node) for r in once.collect()}
    assert {("Box 1", "contains", "Fan"), ("UL Solutions", "party_role_applicant", "Acme"), ("IEC 1", "has_certification", "CB")} <= rows
    assert T.allowed(once).count() == once.count()
    again = {(r.source_node, r.relationship, r.destination_node) for r in T.enforce(once).collect()}
    assert again == rows


def test_empty_input(spark):
    t = spark.createDataFrame([], COLUMNS)
    assert T.enforce(t).count() == 0
    assert canonical.nodes(t).count() == 0 and canonical.edges(t).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_chain(spark):
    e = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(500, 501), (501, 501)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert {got[i] for i in range(200)} == {0} and got[501] == 500


def test_company_clusters(spark):
    t = triplets(spark, ("company", "Acme", "has_product", "product", "A"), ("company", "Acme Electronics Co., Ltd.", "has_product", "product", "B"), ("company", "Acme Display", "has_product", "product", "C"), ("company", "United Technologies", "has_product", "product", "D"), ("company", "United", "has_product", "product", "E"))
    got = {(r.drop_id, r.keep_id) for r in canonical.company_clusters(canonical.nodes(t)).collect()}
    assert got == {("company_acme", "company_acme_electronics")}


def test_exact_root_without_paths_gives_way(spark):
    t = triplets(spark, ("product", "Phone 16", "has_model", "model", "P1"), ("company", "Acme", "has_product", "product", "Phone"))
    plans = spark.createDataFrame([(1, "phone", "product", "models", "", 10)], "plan_id int, entity_name string, entity_label string, path string, terminal_contains string, most int")
    got = [r.ids for r in graph.lineage_paths(plans, canonical.nodes(t), canonical.edges(t)).collect()]
    assert got == ["product_phone_16 > model_p1"]


def test_chunks_keep_pages_whole(spark):
    pages = spark.createDataFrame([(1, "p", "f", i, "x" * n) for i, n in enumerate((60, 50, 10, 200, 1), 1)] + [(2, "p", "f", 1, " ")], "document_id long, project_id string, source_file string, page_number int, text string")
    got = [(r.chunk_id, r.first_page, r.last_page) for r in chunks.chunks(pages, 100).orderBy("chunk_id").collect()]
    assert got == [("chunk_000001", 1, 1), ("chunk_000002", 2, 3), ("chunk_000003", 4, 4), ("chunk_000004", 5, 5)]
    assert [r.document_id for r in chunks.rejected_documents(pages).collect()] == [2]
