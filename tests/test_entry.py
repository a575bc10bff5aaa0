import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_stream_equals_batch(spark, tmp_path):
    from kgloom.operators import canonical
    from kgloom.operators import triplets as T
    from kgloom.streaming.ingest import ingest
    from tests.test_core import triplets

    t = triplets(
        spark,
        ("applicant", "Acme", "has_product", "product", "Box"),
        ("product", "Box", "has_model", "model", "Box 1"),
        ("applicant", "Acme", "produces", "product", "Box"),
    )
    t.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    run = lambda: ingest(spark, str(tmp_path / "in"), t.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = lambda d: sorted((r.source_id, r.relationship, r.destination_id, r.evidence_count) for r in d.collect())
    want = rows(canonical.edges(T.canonicalize(t)))
    assert rows(run()) == want
    assert rows(run()) == want  # nothing new: the same version again
