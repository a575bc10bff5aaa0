"""De-duplication and repair of what was extracted, within a ``project_id``. Rows carry ``seq``; the first one wins.

Entities: project_id, seq, name, entity_type. Triplets as in ``triplets``. Equivalence is found by equal keys and connected
components, never by comparing all pairs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators import extraction as X
from kgloom.operators.components import connected_components
from kgloom.operators.triplets import relation_of, type_of
from kgloom.operators.variants import contained


def buckets(entities: DataFrame) -> DataFrame:
    """The first mention of each (project, type, normal form), with an identity key; unknown types and implausible firms go."""
    x = entities.select("project_id", "seq", N.text(F.col("name")).alias("name"), "entity_type").where("name <> ''").where(F.col("entity_type").isin(*vocab.EXTRACTION_TYPES))
    x = x.where(~F.col("entity_type").isin("company", "applicant") | X.plausible_company(F.col("name"))).withColumn("key", N.norm_key(F.col("name")))
    x = x.groupBy("project_id", "entity_type", "key").agg(F.min(F.struct("seq", "name")).alias("m"))
    return x.select("project_id", "entity_type", F.col("m.seq").alias("seq"), F.col("m.name").alias("name"), F.when(F.col("entity_type").isin("product", "model"), F.concat_ws(":", "entity_type", "key")).otherwise(F.col("key")).alias("identity_key"))


def merged_texts(t: DataFrame, key: list[str], short: str, long: list[str]) -> DataFrame:
    """One row for each key: the shortest short form of the filled texts ``short``, the latest of equals; a text that meets no other, in the
    first row, stays as it is. ``long`` texts are joined by bars, in order of ``seq``, each unless what is there holds it already."""

    def folded(c: str) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(f"{c}_at", F.col(f"{c}_text").alias("t")))), lambda x: x["t"])
        return F.aggregate(ordered, F.lit(""), lambda a, x: F.when(a == "", x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(" | "), x)))

    form, place = f"_{short}_form", F.struct("seq", F.coalesce(short, F.lit("")))
    shaped = t.withColumn(form, N.short_description(F.col(short)))
    least = F.min_by(form, F.when(F.col(form) != "", F.struct(F.length(form), -F.col("seq"), F.col(form))))
    alone = (F.count_if(F.col(form) != "") == 1) & (F.min_by(form, place) != "")
    out = shaped.groupBy(*key).agg(F.when(alone, F.min_by(short, place)).otherwise(F.coalesce(least, F.lit(""))).alias(short), F.min("seq").alias("seq"))
    for c in long:
        # each text once, where it is first, so that a group is no longer than its distinct texts
        once = t.where(F.trim(F.coalesce(c, F.lit(""))) != "").groupBy(*key, F.trim(c).alias(f"{c}_text")).agg(F.min("seq").alias(f"{c}_at"))
        out = out.join(once.groupBy(*key).agg(folded(c).alias(c)), key, "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out


def relationships(t: DataFrame) -> DataFrame:
    """One row for each (types, normal forms of the ends, relation): texts merged, first written ends."""
    x = t.withColumns({"st": F.lower(N.text(F.col("source_type"))), "dt": F.lower(N.text(F.col("destination_type"))), "sk": N.norm_key(F.col("source_node")), "dk": N.norm_key(F.col("destination_node")), "rk": N.norm_key(F.col("relationship"))})
    key = ["project_id", "st", "sk", "rk", "dt", "dk"]
    x = x.where("sk <> '' and dk <> ''")
    first = x.groupBy(*key).agg(F.min(F.struct("seq", "source_node", "destination_node")).alias("f"))
    return merged_texts(x, key, "description", ["keywords"]).join(first, key).select(*key, "seq", F.col("f.source_node").alias("source_node"), F.col("f.destination_node").alias("destination_node"), "description", "keywords")


def standard_form(c: Column) -> Column:
    """Lower case, separators as one space, dots and hyphens kept."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_/|,;]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s.\-]", ""), r"\s+", " "))


NUMBER = r"[0-9]+[a-z0-9]*(?:[.\-][0-9]+[a-z0-9]*)*"


def standards(names: DataFrame) -> DataFrame:
    """``project_id, name, canonical`` of standards that are one: equal forms; equal number and bodies; or two and more bodies of
    which one set lies in the other. The longest name stands for all.

    Sets of one number meet by the rarest body of the smaller one, however many bodies a name has.
    """
    x = names.select("project_id", "name").distinct().withColumn("form", standard_form(F.col("name")))
    bodies = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_extract("form", rf"^(.*?)({NUMBER})(.*)$", 1), " "), lambda w: F.length(w).between(2, 5) & w.rlike(r"^\p{L}+$"))))
    x = x.withColumns({"number": F.regexp_extract("form", rf"^(.*?)({NUMBER})(.*)$", 2), "bodies": bodies})
    node = F.concat_ws("|", F.lit("n"), "project_id", "name")
    own = F.concat_ws("|", F.lit("o"), "project_id", "number", F.array_join("bodies", " "))
    good = (F.col("number") != "") & (F.size("bodies") > 0)
    owned = x.where(good).select(node.alias("a"), own.alias("b"))
    sets = x.where(good).select("project_id", "number", own.alias("id"), "bodies").distinct()
    inside = contained(sets, ["project_id", "number"], "bodies").select(F.col("small").alias("a"), F.col("large").alias("b"))
    found = connected_components(x.select(node.alias("a"), F.concat_ws("|", F.lit("f"), "project_id", "form").alias("b")).union(owned).union(inside))
    member = x.select("project_id", "name", node.alias("node")).join(found, "node")
    best = member.groupBy("component").agg(F.min(F.struct((-F.length("name")).alias("n"), "name"))["name"].alias("canonical"))
    return member.join(best, "component").select("project_id", "name", "canonical")


def renamed(t: DataFrame, renames: DataFrame) -> DataFrame:
    """Triplets with ends replaced by ``project_id, name, canonical``: by the exact name, else its normal form, else its standard form."""
    r = renames.where("name <> canonical")
    forms = [r.select("project_id", F.col("name").alias("form"), "canonical"), r.select("project_id", N.norm_key(F.col("name")).alias("form"), "canonical"), r.select("project_id", standard_form(F.col("name")).alias("form"), "canonical")]
    forms = [f.groupBy("project_id", "form").agg(F.max("canonical").alias("canonical")) for f in forms]
    x = t
    for end in ("source_node", "destination_node"):
        own = [N.text(F.col(end)), N.norm_key(F.col(end)), standard_form(F.col(end))]
        for i, (f, c) in enumerate(zip(forms, own, strict=True)):
            x = x.withColumn("form", c).join(f.withColumnRenamed("canonical", f"c{i}"), ["project_id", "form"], "left")
        x = x.withColumn(end, F.coalesce("c0", "c1", "c2", end)).drop("form", "c0", "c1", "c2")
    return x


def target_names(raw: Column) -> Column:
    """Names of a comma list, commas in brackets left alone; first of equal normal forms."""
    from kgloom.operators.products import EDGE, split_compound

    clean = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    parts = F.filter(F.transform(F.regexp_extract_all(clean, F.lit(r"((?:[^,(]|\([^()]*\)?)+)"), 1), lambda p: F.btrim(p, F.lit(EDGE))), lambda p: p != "")
    names = F.flatten(F.transform(parts, split_compound))
    firsts = lambda xs, keys: F.filter(xs, lambda x, i: F.array_position(keys, keys[i]) == i + 1)
    return N.bind(lambda xs: N.bind(firsts, xs, F.transform(xs, N.norm_key)), names)


# repair of triplets before they are judged


def canonical_relations(t: DataFrame) -> DataFrame:
    """Relation names in canonical form; volumes and sections in theirs."""
    number = lambda k, n: F.when(F.lower(k) == "volume", X.numbered(n, "volume", "vol")).when(F.lower(k) == "section", X.numbered(n, "section", "sec")).otherwise(n)
    return t.withColumns({"relationship": relation_of(F.col("relationship")), "source_node": number(F.col("source_type"), F.col("source_node")), "destination_node": number(F.col("destination_type"), F.col("destination_node"))})


def without_stages(t: DataFrame) -> DataFrame:
    """Without development stages: ``has_variant`` edges, edges on what they lead to, and names marked EVT, DVT or PVT."""
    variant = relation_of(F.col("relationship")) == "has_variant"
    gone = t.where(variant).select("project_id", N.norm_key(F.col("destination_node")).alias("key")).distinct()
    stage = lambda c: F.col(c).rlike(r"(?i)\b(evt|dvt|pvt)[0-9]*\b")
    x = t.where(~variant & ~stage("source_node") & ~stage("destination_node"))
    for end in ("source_node", "destination_node"):
        x = x.withColumn("key", N.norm_key(F.col(end))).join(gone, ["project_id", "key"], "left_anti").drop("key")
    return x


def without_implausible(t: DataFrame) -> DataFrame:
    """Without edges at whose end stands an implausible company or applicant."""
    bad = lambda e: type_of(F.col(f"{e}_type")).isin("company", "applicant") & ~X.plausible_company(F.col(f"{e}_node"))
    return t.where(~bad("source") & ~bad("destination"))


def _tokens(c: str) -> Column:
    return F.array_distinct(F.array_remove(F.split(N.norm_entity(F.col(c)), " "), ""))


def product_models(t: DataFrame) -> DataFrame:
    """``project_id, product, model``: models without a product whose words hold those of exactly one product.

    A product meets models by its longest word, of three letters at least, and is then compared whole.
    """
    end = lambda e, kind, name: t.where(type_of(F.col(f"{e}_type")) == kind).select("project_id", N.norm_key(F.col(f"{e}_node")).alias("key"), F.col(f"{e}_node").alias(name))
    both = lambda kind, name: end("source", kind, name).union(end("destination", kind, name)).groupBy("project_id", "key").agg(F.min(name).alias(name))
    linked = t.where((relation_of(F.col("relationship")) == "has_model") & (type_of(F.col("destination_type")) == "model")).select("project_id", N.norm_key(F.col("destination_node")).alias("key")).distinct()
    p = both("product", "product").withColumn("pw", _tokens("product"))
    p = p.withColumn("word", F.get(F.transform(F.array_sort(F.transform(F.filter("pw", lambda w: F.length(w) >= 3), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), F.lit(0))).where("word is not null")
    m = both("model", "model").join(linked, ["project_id", "key"], "left_anti").withColumn("mw", _tokens("model"))
    met = m.select("project_id", "model", "mw", F.explode("mw").alias("word")).join(p.select("project_id", "product", "pw", "word"), ["project_id", "word"]).where(F.size(F.array_except("pw", "mw")) == 0)
    return met.groupBy("project_id", "model").agg(F.count_distinct("product").alias("n"), F.min("product").alias("product")).where("n = 1").select("project_id", "product", "model")


def model_components(t: DataFrame) -> DataFrame:
    """``project_id, model, component``: components of a product with a single model, where that model lacks them."""
    typed = t.select("project_id", type_of(F.col("source_type")).alias("st"), N.norm_key(F.col("source_node")).alias("s"), relation_of(F.col("relationship")).alias("rel"), type_of(F.col("destination_type")).alias("dt"), N.norm_key(F.col("destination_node")).alias("d")).distinct()
    only = typed.where("st = 'product' and rel = 'has_model' and dt = 'model'").groupBy("project_id", F.col("s").alias("product")).agg(F.count("*").alias("n"), F.min("d").alias("model")).where("n = 1")
    held = typed.where("st = 'product' and rel = 'contains' and dt = 'component'").select("project_id", F.col("s").alias("product"), F.col("d").alias("component"))
    known = typed.where("st = 'model' and rel = 'contains' and dt = 'component'").select("project_id", F.col("s").alias("model"), F.col("d").alias("component"))
    return held.join(only, ["project_id", "product"]).select("project_id", "model", "component").distinct().join(known, ["project_id", "model", "component"], "left_anti")


def within_reach(t: DataFrame, targets: DataFrame) -> DataFrame:
    """Triplets in the part of their project's graph that holds one of its targets (project_id, name); projects without one stay whole."""
    node = lambda c: F.concat_ws("|", "project_id", N.norm_key(F.col(c)))
    found = connected_components(t.select(node("source_node").alias("a"), node("destination_node").alias("b")))
    wanted = targets.select("project_id", node("name").alias("node")).distinct()
    parts = wanted.join(found, "node").select("component").distinct()
    within = t.withColumn("node", node("source_node")).join(found, "node").join(parts, "component", "left_semi").select(t.columns)
    return within.unionByName(t.join(targets.select("project_id").distinct(), "project_id", "left_anti").select(t.columns))


def of_own_project(t: DataFrame, entities: DataFrame) -> DataFrame:
    """Triplets whose two ends are named by the entities of their project."""
    x = t
    for end in ("source_node", "destination_node"):
        x = x.withColumn("key", N.norm_key(F.col(end))).join(entities.select("project_id", N.norm_key(F.col("name")).alias("key")).distinct(), ["project_id", "key"], "left_semi").drop("key")
    return x


def without_named_models(t: DataFrame) -> DataFrame:
    """Without models that only repeat their product's name, where the product has another model; their edges go with them."""
    has = t.where((relation_of(F.col("relationship")) == "has_model") & (type_of(F.col("source_type")) == "product") & (type_of(F.col("destination_type")) == "model"))
    pair = has.select("project_id", N.norm_key(F.col("source_node")).alias("p"), N.norm_key(F.col("destination_node")).alias("key")).distinct()
    other = F.max((F.col("p") != F.col("key")).cast("int")).over(Window.partitionBy("project_id", "p"))
    gone = pair.withColumn("other", other).where("p = key and other = 1").select("project_id", "key").distinct()
    x = t
    for end in ("source", "destination"):
        x = x.withColumn("key", F.when(type_of(F.col(f"{end}_type")) == "model", N.norm_key(F.col(f"{end}_node")))).join(gone, ["project_id", "key"], "left_anti").drop("key")
    return x
