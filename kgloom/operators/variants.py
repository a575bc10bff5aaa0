"""Which names of models, components and standards of a ``project_id`` are variants of one thing.

Sets of words meet by the rarest word of the smaller set, so no pairs are formed on common words; what meets is compared whole. Equivalence
is transitive: variants of a variant belong together, as connected components.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators.components import connected_components, written
from kgloom.operators.triplets import relation_of, type_of


def contained(sets: DataFrame, within: list[str], items: str, least: int = 2) -> DataFrame:
    """``within``, ``small``, ``large``: ids of two sets of which the first, of ``least`` items or more, lies in the other.

    ``sets``: ``within``, ``id`` and an array of distinct ``items``. Equal sets lie in each other. Each set is sought by the item that
    the fewest sets within its group hold; only sets that hold that one are compared.
    """
    sets = written(sets.where(F.size(items) >= least).select(*within, "id", F.col(items).alias("items")))
    words = sets.select(*within, "id", F.explode("items").alias("item"))
    often = words.groupBy(*within, "item").agg(F.count("*").alias("n"))
    rarest = words.join(often, [*within, "item"]).groupBy(*within, "id").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    small = sets.join(rarest, [*within, "id"]).select(*within, "item", F.col("id").alias("small"), F.col("items").alias("few"))
    met = small.join(words.select(*within, "item", F.col("id").alias("large")), [*within, "item"]).where("small <> large")
    whole = sets.select(*within, F.col("id").alias("large"), F.col("items").alias("many"))
    return met.join(whole, [*within, "large"]).where(F.size(F.array_except("few", "many")) == 0).select(*within, "small", "large")


def clustered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node) with their ``component``; nodes without a link are one of their own."""
    found = connected_components(links)
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


# models: words that tell variants apart, and patterns of year, size, generation and revision
SPECS = {"year": r"\b(20[0-9]{2})\b", "size": r"\b([0-9]+\s*(?:inch|in|cm|mm))\b", "generation": r"\b(gen(?:eration)?\s*[0-9]+|g[0-9]+)\b", "revision": r"\b(v[0-9]+|rev\s*[0-9]+|r[0-9]+)\b"}


def words(key: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(key, " "), "")))


def model_variants(models: DataFrame, t: DataFrame) -> DataFrame:
    """``project_id, name, canonical`` of models (project_id, seq, name) that are one.

    Two are if their normal forms agree; or if the words of one, two or more, lie in the other's, both state no different years,
    sizes, generations or revisions, both have the same words of variants, and their products in the triplets ``t`` overlap where
    both have some. The name of most words, then the longest, then the first stands for all.
    """
    m = models.select("project_id", "seq", F.trim("name").alias("name")).where("name <> ''").withColumn("key", N.norm_key(F.col("name")))
    m = written(m)
    has = t.where((relation_of(F.col("relationship")) == "has_model") & (type_of(F.col("source_type")) == "product") & (type_of(F.col("destination_type")) == "model"))
    parents = has.select("project_id", N.norm_key(F.col("destination_node")).alias("key"), N.norm_key(F.col("source_node")).alias("parent")).where("key <> '' and parent <> ''").distinct()
    keys = m.where("key <> ''").select("project_id", "key").distinct()
    keys = keys.select("project_id", F.col("key").alias("id"), words(F.col("key")).alias("words"), *[F.array_distinct(F.regexp_extract_all("key", F.lit(p), 1)).alias(k) for k, p in SPECS.items()])
    keys = written(keys.withColumn("marks", F.array_intersect("words", F.array(*map(F.lit, vocab.VARIANT_MARKS)))))
    pairs = contained(keys, ["project_id"], "words").join(keys.drop("words").withColumnsRenamed({"id": "small"}), ["project_id", "small"])
    other = keys.drop("words").withColumnsRenamed({"id": "large"} | {k: f"{k}_2" for k in [*SPECS, "marks"]})
    pairs = pairs.join(other, ["project_id", "large"])
    same_set = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    agree = reduce(lambda x, k: x & ((F.size(k) == 0) | (F.size(f"{k}_2") == 0) | same_set(k, f"{k}_2")), SPECS, same_set("marks", "marks_2"))
    pairs = written(pairs.where(agree).select("project_id", "small", "large"))
    # products overlap, or one side has none
    of = lambda c: parents.select("project_id", F.col("key").alias(c), "parent")
    common = pairs.join(of("small"), ["project_id", "small"]).join(of("large"), ["project_id", "large", "parent"]).select("project_id", "small", "large").distinct()
    owned = parents.select("project_id", "key").distinct()
    free = [pairs.join(owned.withColumnRenamed("key", c), ["project_id", c], "left_anti").select("project_id", "small", "large") for c in ("small", "large")]
    links = common.union(free[0]).union(free[1])
    node = lambda c: F.concat_ws("|", "project_id", F.col(c))
    one = clustered(m.select(node("key").alias("node")).distinct(), links.select(node("small").alias("a"), node("large").alias("b")))
    member = m.withColumn("node", node("key")).join(one, "node")
    rank = F.struct((-F.size(words(F.col("key")))).alias("w"), (-F.length("name")).alias("n"), "seq", "name")
    best = member.groupBy("component").agg(F.min(rank)["name"].alias("canonical"))
    return member.join(best, "component").select("project_id", "name", "canonical").distinct()


#: A part number: letters first, then marks and further parts, with a digit somewhere.
PART_NUMBER = r"(?i)\b(?=[A-Z0-9\-/]*[0-9])([A-Z]{1,8}[0-9]*[A-Z0-9]*[-/][A-Z0-9]+(?:[-/][A-Z0-9]+)*)\b"


def part_numbers(text: Column) -> Column:
    """Distinct part numbers in capitals; designations of standards are none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PART_NUMBER), 1), F.upper)
    return F.array_distinct(F.filter(found, lambda x: ~F.lower(F.regexp_extract(x, r"^([^0-9\-/]*)", 1)).isin(*vocab.STANDARD_BODIES)))


def singular(key: Column) -> Column:
    """A normal form with its last word in the singular, where that is safe: four letters or more, and no ss, us, is, ics at its end."""
    head, last = F.regexp_extract(key, r"^(.* )?([^ ]*)$", 1), F.regexp_extract(key, r"^(.* )?([^ ]*)$", 2)
    n = F.length(last)
    cut = (
        F.when((n < 4) | last.rlike("(ss|us|is|ics)$"), last)
        .when(last.rlike("ies$") & (n >= 5), F.concat(F.substring(last, F.lit(1), n - 3), F.lit("y")))
        .when(last.rlike("(ches|shes|xes|zes)$"), F.substring(last, F.lit(1), n - 2))
        .when(last.rlike("s$"), F.substring(last, F.lit(1), n - 1))
        .otherwise(last)
    )
    return F.concat(head, cut)


def component_variants(components: DataFrame) -> DataFrame:
    """``project_id, seq, name, canonical`` of components (project_id, seq, name, evidence, component_description) that are one.

    Two are if their texts share a part number; where neither has one, if their whole texts are equal but for a plural at the end.
    One with a part number and one without are never one. A readable name with a part number stands for all before others, then the one of
    most words, the longest, the first.
    """
    text = F.concat_ws(" ", *[F.when(F.trim(c) != "", F.trim(c)) for c in ("name", "evidence", "component_description")])
    c = components.select("project_id", "seq", F.trim("name").alias("name"), "evidence", text.alias("text")).where("name <> ''")
    c = written(c.withColumn("parts", part_numbers(F.col("text"))).withColumn("node", F.concat_ws("|", F.lit("i"), "project_id", "seq", "name")))
    by_part = c.select(F.col("node").alias("a"), "project_id", F.explode("parts").alias("p")).select("a", F.concat_ws("|", F.lit("p"), "project_id", "p").alias("b"))
    by_text = c.where(F.size("parts") == 0).select(F.col("node").alias("a"), "project_id", singular(N.norm_key(F.col("text"))).alias("k")).where("k <> ''").select("a", F.concat_ws("|", F.lit("k"), "project_id", "k").alias("b"))
    one = clustered(c.select("node").distinct(), by_part.union(by_text))
    member = c.join(one, "node")
    type_words = F.size(F.filter(F.regexp_extract_all("name", F.lit("([A-Za-z]+)"), 1), lambda w: ~F.lower(w).isin("rev", "revision")))
    # at the very start of the name stands no part number
    at_start = F.regexp_extract("name", PART_NUMBER.replace(r"(?i)\b", "(?i)^", 1), 1) != ""
    shown = (F.size(part_numbers(F.concat_ws(" ", "name", F.coalesce("evidence", F.lit(""))))) > 0) & (type_words > 0) & ~at_start
    rank = F.struct((~shown).alias("s"), (-type_words).alias("w"), (-F.length("name")).alias("n"), F.col("seq"), F.col("name"))
    best = member.groupBy("component").agg(F.min(rank)["name"].alias("canonical"))
    return member.join(best, "component").select("project_id", "seq", "name", "canonical")
