"""What queries must not do more often than once, or hold for each pair."""

from pyspark.sql import functions as F

from kgloom.operators import canonical
from kgloom.operators import extraction as X


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_parsed_once(spark):
    body = '{"entities":[{"name":"Vol. 3","type":"Volume"},{"name":" ","type":"product"},{"name":"UL LLC","type":"TestRecord"}],"relationships":[]}'
    texts = [f"Here: ```json {body}\n```", body[:40], "} no {", None, body]
    r = spark.createDataFrame([("p", "d", str(i), t) for i, t in enumerate(texts)], "project_id string, document_id string, chunk_id string, response string")
    r = r.withColumn("response", F.regexp_replace("response", "x+", "x"))
    for f in (X.at_cap, X.entities, X.relationships):
        plan = plan_of(f(r))
        assert plan.count("from_json") == 1 and plan.count("regexp_replace(response") == 1, f.__name__
    assert sorted((x.chunk_id, x.entities, x.relationships) for x in X.at_cap(r).collect()) == [("0", 2, 0), ("4", 2, 0)]
    assert sorted((x.chunk_id, x.pos, x.name, x.entity_type) for x in X.entities(r).collect()) == [(c, i, *e) for c in "04" for i, e in enumerate([("Volume 3", "volume"), ("UL Solutions", "ul")])]


def test_makers_and_owners_that_share_many_parts_meet_once(spark):
    import random

    pick = random.Random(7)
    rows = [("MAKES", f"c{pick.randrange(9)}", f"m{pick.randrange(12)}") for _ in range(60)] + [("HAS_PRODUCT", f"m{pick.randrange(20)}", f"p{pick.randrange(6)}") for _ in range(40)]
    rows += [("HAS_MODEL", f"p{pick.randrange(6)}", f"x{pick.randrange(6)}") for _ in range(8)] + [("CONTAINS", f"{pick.choice('px')}{pick.randrange(6)}", f"c{pick.randrange(9)}") for _ in range(12)]
    rows += [("PARTY_ROLE_SUPPLIER", f"m{i}", f"m{i + 1}") for i in range(20)]
    rows = [("PARTY_ROLE_MANUFACTURER" if r == "MAKES" else r, a, b) for r, a, b in rows]
    of = lambda rel: {(a, b) for r, a, b in rows if r == rel}
    held = {(o, c) for o, p in of("HAS_PRODUCT") for q, c in of("CONTAINS") if q == p or (p, q) in of("HAS_MODEL")}
    want = {(m, o) for c, m in of("PARTY_ROLE_MANUFACTURER") for o, d in held if c == d and m != o} - of("PARTY_ROLE_SUPPLIER")
    new = canonical.link_suppliers(spark.createDataFrame(rows, "relationship string, source_id string, destination_id string"))
    got = [tuple(r) for r in new.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    # no pair is counted again for each part that it shares
    assert "Aggregate" not in plan_of(new)
