"""The canonical graph: nodes and edges from triplets, and what is done to them after."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators.components import written
from kgloom.operators.named import sharing, small, with_ends


def ends(t: DataFrame) -> DataFrame:
    """Both ends of each triplet: kind, name, canonical id, and what the triplet says."""
    x = with_ends(t, entity_type=lambda k, n: N.graph_type(k), name=lambda k, n: N.text(n), canonical_id=N.canonical_id)
    end = lambda p, e: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("entity_type", "name", "canonical_id")], F.lit(e).alias("end"))
    return x.select("document_id", "seq", "description", F.inline(F.array(end("s", 0), end("d", 1))))


def nodes(t: DataFrame) -> DataFrame:
    """One row for each kind and id: first name, aliases, shortest description, number of mentions."""
    x = ends(t)
    order = F.struct("seq", "end")
    out = x.groupBy("entity_type", "canonical_id").agg(
        F.min_by("name", order).alias("name"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.min(F.when(F.col("description") != "", F.struct(F.length("description").alias("n"), F.col("description").alias("d"))))["d"].alias("description"),
        F.count("*").alias("mentions"),
    )
    return out.select("entity_type", "canonical_id", "name", N.norm_for_type(F.col("entity_type"), F.col("name")).alias("normalized_name"), F.array_remove(F.col("names"), F.col("name")).alias("aliases"), F.coalesce("description", F.lit("")).alias("description"), "mentions")


def edges(t: DataFrame) -> DataFrame:
    """One row for each (source, RELATION, destination): first description and keywords that aren't empty, all documents."""
    x = with_ends(t, kind=lambda k, n: N.graph_type(k), id=N.canonical_id).select(
        F.col("s_kind").alias("source_type"), F.col("s_id").alias("source_id"), N.relation_type(F.col("relationship")).alias("relationship"),
        F.col("d_kind").alias("destination_type"), F.col("d_id").alias("destination_id"), "document_id", "seq", "description", "keywords",
    )
    filled = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit(""))
    out = x.groupBy("source_type", "source_id", "relationship", "destination_type", "destination_id")
    return out.agg(filled("description").alias("description"), filled("keywords").alias("keywords"), F.array_sort(F.collect_set(F.when(F.col("document_id") != "", F.col("document_id")))).alias("document_ids"), F.count("*").alias("evidence_count"))


def parent_hints(t: DataFrame) -> DataFrame:
    """Parents that are part of the identity of products, models and clauses."""
    s, d = N.graph_type(F.col("source_type")), N.graph_type(F.col("destination_type"))
    rel = F.lower(N.text(F.col("relationship")))
    met = ((rel == "has_clause") & (s == "standard") & (d == "clause")) | (rel.isin("has_product", "produces") & (s == "company") & (d == "product")) | ((rel == "has_model") & (s == "product") & (d == "model"))
    t = t.select("source_type", "source_node", "relationship", "destination_type", "destination_node").distinct()
    return t.where(met).select(d.alias("entity_type"), N.text(F.col("destination_node")).alias("name"), N.text(F.col("source_node")).alias("parent")).distinct()


def mentions(t: DataFrame) -> DataFrame:
    """Distinct (kind, name, parent) with their rank in the order of resolution."""
    rank = N.lookup({k: i for i, k in enumerate(vocab.CANONICAL_TYPES)}, F.col("entity_type"), F.lit(len(vocab.CANONICAL_TYPES))).cast("int")
    x = ends(t).select("entity_type", "name").distinct().join(parent_hints(t), ["entity_type", "name"], "left")
    return x.select("entity_type", "name", F.coalesce("parent", F.lit("")).alias("parent"), rank.alias("type_rank"))


def drop_disallowed(e: DataFrame) -> DataFrame:
    """Without supplier edges that touch a component."""
    return e.where(~((F.col("relationship") == "PARTY_ROLE_SUPPLIER") & ((F.col("source_type") == "component") | (F.col("destination_type") == "component"))))


def link_suppliers(e: DataFrame) -> DataFrame:
    """New edges: the manufacturer of a component supplies the company whose product contains it."""
    of = lambda rel, a, b: e.where(F.col("relationship") == rel).select(F.col("source_id").alias(a), F.col("destination_id").alias(b)).distinct()
    has = of("CONTAINS", "key", "component")
    owner = written(of("HAS_PRODUCT", "b", "key"))
    within = has.union(of("HAS_MODEL", "key", "model").join(of("CONTAINS", "model", "component"), "model").select("key", "component")).join(owner.select("key").distinct(), "key", "left_semi").distinct()
    makes = of("PARTY_ROLE_MANUFACTURER", "component", "a").join(within, "component").select("a", "key").distinct()
    new = sharing(makes, owner).where("a <> b").select(F.col("a").alias("source_id"), F.col("b").alias("destination_id"))
    known = small(written(e.where("relationship = 'PARTY_ROLE_SUPPLIER'").select("source_id", "destination_id").distinct()))
    return new.join(known, ["source_id", "destination_id"], "left_anti")


def link_certifications(e: DataFrame) -> DataFrame:
    """New edges: standard and certification of one component."""
    part = lambda rel, t, k: e.where((F.col("relationship") == rel) & (F.col("source_type") == "component") & (F.col("destination_type") == t)).select(F.col("source_id").alias("component"), F.col("destination_id").alias(k)).distinct()
    pairs = part("COMPLIES_WITH", "standard", "source_id").join(part("HAS_CERTIFICATION", "certification", "destination_id"), "component").select("source_id", "destination_id").distinct()
    known = e.where("relationship = 'HAS_CERTIFICATION' and source_type = 'standard'").select("source_id", "destination_id")
    return pairs.join(known, ["source_id", "destination_id"], "left_anti")


def evidence_ids(t: DataFrame) -> DataFrame:
    """Deterministic ids of provenance rows."""
    parts = F.concat_ws("|", "document_id", F.lit("relationship"), "s_id", F.lit(""), F.lit(""), N.relation_type(F.col("relationship")))
    return with_ends(t, id=N.canonical_id).select("seq", F.concat(F.lit("ev_"), F.substring(F.sha2(parts.cast("binary"), 256), 1, 24)).alias("evidence_id"))


def absorb(e: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with ids replaced by ``drop_id, keep_id`` rows; loops go, equal edges become one."""
    s = renames.select(F.col("drop_id").alias("source_id"), F.col("keep_id").alias("new_source"))
    d = renames.select(F.col("drop_id").alias("destination_id"), F.col("keep_id").alias("new_destination"))
    x = e.join(s, "source_id", "left").join(d, "destination_id", "left")
    x = x.withColumns({"source_id": F.coalesce("new_source", "source_id"), "destination_id": F.coalesce("new_destination", "destination_id")}).where("source_id <> destination_id")
    return x.groupBy("source_type", "source_id", "relationship", "destination_type", "destination_id").agg(F.sum("evidence_count").alias("evidence_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("document_ids")))).alias("document_ids"))


def company_clusters(n: DataFrame) -> DataFrame:
    """``drop_id, keep_id`` of equivalent companies: closure of equal forms, generic tails and suffixes of words.

    Each longer name emits its shorter forms as keys and meets full names by equality; no pairs are scanned.
    """
    from kgloom.operators.components import connected_components

    c = n.where("entity_type = 'company'").select("canonical_id", "name", N.words(N.norm_company(F.col("name"))).alias("w"), N.words(N.norm_entity(F.col("name"))).alias("full"))
    generic = F.array(*[F.lit(w) for w in vocab.GENERIC_ORG_WORDS])
    # places where everything behind is generic; the first word always stays
    tails = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda k: (k < F.size("w")) & (F.size(F.array_except(F.slice("w", k + 1, F.size("w")), generic)) == 0)), lambda k: F.concat(F.lit("c:"), F.array_join(F.slice("w", 1, k), " ")))
    ends_of = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size("full") - 1, F.lit(2))), lambda k: k < F.size("full")), lambda k: F.concat(F.lit("e:"), F.array_join(F.slice("full", F.size("full") - k + 1, k), " ")))
    own = F.array(F.concat(F.lit("c:"), F.array_join("w", " ")), F.concat(F.lit("e:"), F.array_join("full", " ")))
    weak = (F.size(F.split(F.col("key"), " ")) == 1) & F.substring("key", 3, 1000).isin(*vocab.WEAK_COMPANY_WORDS)
    full = c.select("canonical_id", F.explode(own).alias("key"))
    short = c.where("size(w) > 0").select("canonical_id", F.explode(F.array_union(tails, ends_of)).alias("key")).where(~weak)
    # an id and its keys form a bipartite graph: a key that a full name bears joins all that reduce to it
    keyed = full.union(short.join(full.select("key").distinct(), "key", "left_semi").select("canonical_id", "key"))
    found = connected_components(keyed.select(F.concat(F.lit("~"), F.col("key")).alias("a"), F.col("canonical_id").alias("b")))
    member = n.where("entity_type = 'company'").join(found, F.col("canonical_id") == F.col("node")).select("component", "canonical_id", "name")
    rank = F.struct((N.norm_entity(F.col("name")) != N.norm_company(F.col("name"))).cast("int"), F.length("name"), F.col("canonical_id"))
    best = member.groupBy("component").agg(F.max_by("canonical_id", rank).alias("keep_id"))
    return member.join(best, "component").where("canonical_id <> keep_id").select(F.col("canonical_id").alias("drop_id"), "keep_id")
