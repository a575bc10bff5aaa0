"""Rules on triplets. All work within a ``project_id``; ``seq`` is the input order, and the first one wins.

Triplets: project_id, document_id, seq, source_type, source_node, relationship, destination_type, destination_node,
description, keywords. Null counts as empty everywhere.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators.components import written
from kgloom.operators.named import with_ends

KEY = ["project_id", "source_type", "source_node", "relationship", "destination_type", "destination_node"]
COLUMNS = ["project_id", "document_id", "seq", *KEY[1:], "description", "keywords"]
ALLOWED = ["|".join(r) for r in vocab.RULES]
PAIR_RELATION = {f"{s}|{d}": r for s, r, d in vocab.RULES}


def type_of(c: Column) -> Column:
    raw = F.lower(N.text(c))
    return N.lookup(vocab.TYPE_ALIASES, F.when(raw == "", "entity").otherwise(raw))


def relation_of(c: Column) -> Column:
    return N.lookup(vocab.RELATION_ALIASES, F.translate(F.lower(N.text(c)), " -", "__"))


def end_type(name: Column, kind: Column) -> Column:
    return F.when(N.is_root(name), "ul").otherwise(type_of(kind))


def _typed(t: DataFrame) -> DataFrame:
    """With normal types, relation and name keys beside the given columns."""
    return t.withColumns(
        {
            "st": type_of(F.col("source_type")),
            "dt": type_of(F.col("destination_type")),
            "rel": relation_of(F.col("relationship")),
            "sk": N.norm_key(F.col("source_node")),
            "dk": N.norm_key(F.col("destination_node")),
        }
    )


def from_relationships(r: DataFrame) -> DataFrame:
    """Relationship mentions as triplets: lower-case types, short descriptions; incomplete ones go."""
    out = r.select(
        "project_id",
        "document_id",
        "seq",
        F.lower(N.text(F.col("source_type"))).alias("source_type"),
        N.text(F.col("source_node")).alias("source_node"),
        N.text(F.col("relationship")).alias("relationship"),
        F.lower(N.text(F.col("destination_type"))).alias("destination_type"),
        N.text(F.col("destination_node")).alias("destination_node"),
        N.short_description(F.col("description")).alias("description"),
        N.text(F.col("keywords")).alias("keywords"),
    )
    return out.where("source_node <> '' and destination_node <> '' and relationship <> ''")


def judge(t: DataFrame) -> DataFrame:
    """Triplets in canonical form, with ``verdict``: kept, flipped, defaulted, or why a triplet is rejected."""
    x = with_ends(N.with_short_description(t, "description"), name=lambda k, n: N.text(n), kind=lambda k, n: end_type(N.text(n), k)).select(
        "project_id", "document_id", "seq", F.col("s_name").alias("s"), F.col("d_name").alias("d"), F.col("s_kind").alias("st"), F.col("d_kind").alias("dt"),
        relation_of(F.col("relationship")).alias("rel"), "description", N.text(F.col("keywords")).alias("keywords"),
    )
    known = F.col("rel").isin(*{r for _, r, _ in vocab.RULES})
    pair = lambda a, b: F.create_map(*[F.lit(v) for kv in PAIR_RELATION.items() for v in kv])[F.concat_ws("|", a, b)]
    x = x.withColumns({"ahead": F.when(~known, pair("st", "dt")), "back": F.when(~known, pair("dt", "st"))})
    verdict = (
        F.when((F.col("s") == "") | (F.col("d") == ""), "empty name")
        .when(F.col("rel") == "serves", "serves")
        .when(F.concat_ws("|", "st", "rel", "dt").isin(*ALLOWED), "kept")
        .when(F.concat_ws("|", "dt", "rel", "st").isin(*ALLOWED), "flipped")
        .when(F.col("ahead").isNotNull(), "defaulted")
        .when(F.col("back").isNotNull(), "defaulted back")
        .otherwise("not allowed")
    )
    x = x.withColumn("verdict", verdict).withColumn("turn", F.col("verdict").isin("flipped", "defaulted back"))
    swap = lambda a, b: F.when(F.col("turn"), F.col(b)).otherwise(F.col(a))
    relation = F.when(F.col("verdict") == "defaulted", F.col("ahead")).when(F.col("verdict") == "defaulted back", F.col("back")).otherwise(F.col("rel"))
    return x.select(
        "project_id", "document_id", "seq", swap("st", "dt").alias("source_type"), swap("s", "d").alias("source_node"), relation.alias("relationship"),
        swap("dt", "st").alias("destination_type"), swap("d", "s").alias("destination_node"), "description", "keywords", "verdict",
    )


def canonicalize(t: DataFrame) -> DataFrame:
    return judge(t).where(F.col("verdict").isin("kept", "flipped", "defaulted", "defaulted back")).drop("verdict")


def rejected(t: DataFrame) -> DataFrame:
    return judge(t).where(F.col("verdict").isin("empty name", "serves", "not allowed"))


def first_filled(c: str) -> Column:
    """The first value that isn't empty, by ``seq``."""
    return F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("seq"))), F.lit(""))


def dedupe(t: DataFrame) -> DataFrame:
    """One row for each exact triplet of a project; later ones only fill what is missing."""
    return t.groupBy(*KEY).agg(F.min_by("document_id", "seq").alias("document_id"), first_filled("description").alias("description"), first_filled("keywords").alias("keywords"), F.min("seq").alias("seq")).select(COLUMNS)


def allowed(t: DataFrame) -> DataFrame:
    x = F.concat_ws("|", type_of(F.col("source_type")), relation_of(F.col("relationship")), type_of(F.col("destination_type")))
    return t.where(x.isin(*ALLOWED))


def applicants(t: DataFrame) -> DataFrame:
    """``project_id, key, name, seq`` of applicants: typed so, owning a product, or named so by a relation."""
    x = _typed(t)
    ends = F.filter(
        F.array(
            F.when((F.col("st") == "applicant") | ((F.col("rel") == "has_product") & F.col("st").isin("applicant", "company")), F.struct(F.col("source_node").alias("name"), F.lit(0).alias("end"))),
            F.when((F.col("dt") == "applicant") | (F.col("rel") == "party_role_applicant"), F.struct(F.col("destination_node").alias("name"), F.lit(1).alias("end"))),
        ),
        lambda e: e.isNotNull(),
    )
    x = x.select("project_id", "seq", F.inline(ends)).select("project_id", "seq", "end", N.text(F.col("name")).alias("name"))
    x = x.where((F.col("name") != "") & ~N.is_root(F.col("name")) & ~N.is_generic_org(F.col("name")))
    return x.groupBy("project_id", N.norm_key(F.col("name")).alias("key")).agg(F.min_by("name", F.struct("seq", "end")).alias("name"), F.min("seq").alias("seq"))


def root_links(t: DataFrame) -> DataFrame:
    """Links from the root to applicants that have none."""
    x = _typed(t).where((F.col("rel") == "party_role_applicant") & (end_type(F.col("source_node"), F.col("source_type")) == "ul"))
    new = applicants(t).join(x.select("project_id", F.col("dk").alias("key")).distinct(), ["project_id", "key"], "left_anti")
    return new.select(
        "project_id", F.lit("").alias("document_id"), "seq", F.lit("ul").alias("source_type"), F.lit("UL Solutions").alias("source_node"), F.lit("party_role_applicant").alias("relationship"), F.lit("applicant").alias("destination_type"),
        F.col("name").alias("destination_node"), F.concat(F.lit("UL applicant link for '"), F.col("name"), F.lit("'.")).alias("description"), F.lit("PARTY_ROLE_APPLICANT").alias("keywords"),
    )


def refine_ownership(t: DataFrame) -> DataFrame:
    """Components belong to models: product edges move to the product's only model, or go."""
    x = _typed(t)
    owned = x.where("rel = 'has_model' and st = 'product' and dt = 'model'").select("project_id", F.col("sk").alias("product"), F.col("dk").alias("model")).distinct()
    ends = x.select("project_id", "seq", F.inline(F.array(F.struct(F.col("st").alias("t"), F.col("sk").alias("k"), F.col("source_node").alias("n"), F.lit(0).alias("e")), F.struct(F.col("dt").alias("t"), F.col("dk").alias("k"), F.col("destination_node").alias("n"), F.lit(1).alias("e"))))).where("t = 'model'")
    shown = ends.groupBy("project_id", F.col("k").alias("model")).agg(F.max_by(N.text(F.col("n")), F.struct("seq", "e")).alias("shown"))
    has = x.where("rel = 'contains' and st = 'model'").select("project_id", F.col("sk").alias("model"), F.col("dk").alias("dk")).distinct()
    count = owned.join(shown, ["project_id", "model"], "left").groupBy("project_id", F.col("product").alias("sk")).agg(F.count("*").alias("n_models"), F.min("shown").alias("shown"))
    held = owned.join(has, ["project_id", "model"]).select("project_id", F.col("product").alias("sk"), "dk").distinct().withColumn("held", F.lit(True))
    edge = (F.col("rel") == "contains") & (F.col("st") == "product")
    named = shown.select("project_id", F.col("model").alias("sk"), F.lit(True).alias("is_model"))
    moved = (
        x.where(edge)
        .join(count, ["project_id", "sk"], "left")
        .join(held, ["project_id", "sk", "dk"], "left_anti")
        .join(named, ["project_id", "sk"], "left")
        .where("n_models = 1 or (n_models is null and is_model)")
    )
    keywords = F.when(N.text(F.col("keywords")) == "", "CONTAINS").otherwise(F.col("keywords"))
    moved = moved.withColumns({"source_node": F.when(F.col("n_models") == 1, F.col("shown")).otherwise(F.col("source_node")), "source_type": F.lit("model"), "relationship": F.lit("contains"), "keywords": keywords})
    return t.where(~((relation_of(F.col("relationship")) == "contains") & (type_of(F.col("source_type")) == "product"))).select(COLUMNS).union(moved.select(COLUMNS))


def link_certifications(t: DataFrame) -> DataFrame:
    """Standards and certifications of one component, linked where they aren't yet."""
    x = _typed(t)
    first = lambda d, k: d.groupBy("project_id", "component", k).agg(F.min_by("name", "seq").alias(f"{k}_name"), F.min("seq").alias(f"{k}_seq"))
    part = lambda rel, dt, k: first(x.where((F.col("rel") == rel) & (F.col("st") == "component") & (F.col("dt") == dt)).select("project_id", F.col("sk").alias("component"), F.col("dk").alias(k), N.text(F.col("destination_node")).alias("name"), "seq"), k)
    pairs = part("complies_with", "standard", "std").join(part("has_certification", "certification", "cert"), ["project_id", "component"])
    known = x.where("rel = 'has_certification' and st = 'standard' and dt = 'certification'").select("project_id", F.col("sk").alias("std"), F.col("dk").alias("cert")).distinct()
    new = pairs.join(known, ["project_id", "std", "cert"], "left_anti").groupBy("project_id", "std", "cert")
    order = F.struct("cert_seq", "std_seq")
    new = new.agg(F.min_by("std_name", order).alias("source_node"), F.min_by("cert_name", order).alias("destination_node"), F.min("std_seq").alias("seq"))
    return new.select(
        "project_id", F.lit("").alias("document_id"), "seq", F.lit("standard").alias("source_type"), "source_node", F.lit("has_certification").alias("relationship"), F.lit("certification").alias("destination_type"), "destination_node",
        F.lit("").alias("description"), F.lit("HAS_CERTIFICATION").alias("keywords"),
    )


def suppliers(t: DataFrame) -> DataFrame:
    """Supplier edges as company -> applicant, from supplier and manufacturer edges.

    A component's applicants are the owners of the products (or products of the models) that contain it;
    supplier edges without one go to all applicants of the project, manufacturer edges to none.
    """
    x = written(_typed(t))  # read by ten joins below
    app = written(applicants(t)).select("project_id", F.col("key").alias("app"), F.col("name").alias("app_name"))
    owner = x.where("rel = 'has_product' and st in ('applicant', 'company') and dt = 'product'").select("project_id", F.col("dk").alias("product"), F.col("sk").alias("app")).distinct().join(app, ["project_id", "app"])
    model = x.where("rel = 'has_model' and st = 'product' and dt = 'model'").select("project_id", F.col("sk").alias("product"), F.col("dk").alias("parent")).distinct()
    within = x.where("rel = 'contains' and dt = 'component' and st in ('product', 'model')").select("project_id", "st", F.col("sk").alias("parent"), F.col("dk").alias("component")).distinct()
    direct = within.where("st = 'product'").select("project_id", F.col("parent").alias("product"), "component")
    by_model = within.where("st = 'model'").join(model, ["project_id", "parent"]).select("project_id", "product", "component")
    of_component = written(direct.union(by_model).distinct().join(owner, ["project_id", "product"]).select("project_id", "component", "app", "app_name").distinct())

    s, d = N.text(F.col("source_node")), N.text(F.col("destination_node"))
    e = x.where("rel in ('party_role_supplier', 'party_role_manufacturer')").withColumns({"st": end_type(s, F.col("source_type")), "dt": end_type(d, F.col("destination_type")), "s": s, "d": d, "made": F.col("rel") == "party_role_manufacturer"})
    ahead, back = (F.col("st") == "component") & (F.col("dt") == "company"), (F.col("dt") == "component") & (F.col("st") == "company")
    parts = e.where(ahead | back).withColumns({"supplier": F.when(ahead, F.col("d")).otherwise(F.col("s")), "component": F.when(ahead, F.col("sk")).otherwise(F.col("dk"))})
    parts = parts.select("project_id", "seq", "made", "supplier", "component", "keywords")
    found = parts.join(of_component, ["project_id", "component"]).drop("component")
    lost = parts.where("not made").join(of_component.select("project_id", "component").distinct(), ["project_id", "component"], "left_anti").drop("component")

    firms = e.where("not made").where("st in ('company', 'applicant') and dt in ('company', 'applicant') and not (st = 'applicant' and dt = 'applicant')")
    typed = firms.where("st = 'applicant' or dt = 'applicant'")
    typed = typed.select("project_id", "seq", "made", F.when(F.col("dt") == "applicant", F.col("s")).otherwise(F.col("d")).alias("supplier"), "keywords", N.norm_key(F.when(F.col("dt") == "applicant", F.col("d")).otherwise(F.col("s"))).alias("app"), F.when(F.col("dt") == "applicant", F.col("d")).otherwise(F.col("s")).alias("app_name"))
    plain = firms.where("st = 'company' and dt = 'company'")
    plain = plain.join(app.select("project_id", F.col("app").alias("dk"), F.col("app_name").alias("d_name")), ["project_id", "dk"], "left").join(app.select("project_id", F.col("app").alias("sk"), F.col("app_name").alias("s_name")), ["project_id", "sk"], "left")
    to_d, to_s = F.col("d_name").isNotNull(), F.col("s_name").isNotNull()
    known = plain.where(to_d | to_s).select("project_id", "seq", "made", F.when(to_d, F.col("s")).otherwise(F.col("d")).alias("supplier"), "keywords", F.when(to_d, F.col("dk")).otherwise(F.col("sk")).alias("app"), F.when(to_d, F.col("d_name")).otherwise(F.col("s_name")).alias("app_name"))
    lost = lost.unionByName(plain.where(~to_d & ~to_s).select("project_id", "seq", "made", F.col("s").alias("supplier"), "keywords"))
    all_rows = found.unionByName(typed).unionByName(known).unionByName(lost.join(app, "project_id"))
    key = N.norm_key(F.col("supplier"))
    all_rows = all_rows.withColumn("supplier_key", key).where((F.col("supplier") != "") & (F.col("supplier_key") != F.col("app")))
    order = F.struct("made", "seq")
    out = all_rows.groupBy("project_id", "supplier_key", "app").agg(F.min_by("supplier", order).alias("source_node"), F.min_by("app_name", F.struct("made", "seq", "app_name")).alias("destination_node"), F.min(order).alias("o"), F.min_by(N.text(F.col("keywords")), order).alias("keywords"))
    return out.select(
        "project_id", F.lit("").alias("document_id"), F.col("o.seq").alias("seq"), F.lit("company").alias("source_type"), "source_node", F.lit("party_role_supplier").alias("relationship"), F.lit("applicant").alias("destination_type"), "destination_node",
        F.lit("").alias("description"), F.when(F.col("keywords") == "", "PARTY_ROLE_SUPPLIER").otherwise(F.col("keywords")).alias("keywords"),
    )


def enforce(t: DataFrame) -> DataFrame:
    """The rules in their order: ownership, suppliers, certifications, canonical form, duplicates, root links."""
    owned = written(refine_ownership(t))
    supplied = written(owned.where(relation_of(F.col("relationship")) != "party_role_supplier").select(COLUMNS).unionByName(suppliers(owned)))
    linked = written(supplied.unionByName(link_certifications(supplied)))
    one = written(dedupe(canonicalize(linked).select(COLUMNS)))
    return one.unionByName(root_links(one).select(COLUMNS))
