"""Organisations of one project under several names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators.components import connected_components, written


def company_variants(firms: DataFrame) -> DataFrame:
    """``project_id, kind, name, canonical`` of the distinct names of firms (project_id, kind, seq, name), as written but for spaces at the ends.

    Names are one firm if their normal forms or cores are equal, if a core is another with generic words behind (a single weak word aside), or if
    a normal form of two words or more ends another; and through names between them. Shorter forms are made from each name and
    must be those of a name, so only equal keys meet. Of a firm's names the best with a legal form and the longest (the
    earlier of equals) compete as ``preferred``. Empty names go, nulls in project and kind count as empty, names of marks only stand alone.
    """
    x = firms.select(F.coalesce("project_id", F.lit("")).alias("project_id"), F.coalesce("kind", F.lit("")).alias("kind"), "seq", N.text(F.col("name")).alias("name")).where("name <> ''")
    x = x.groupBy("project_id", "kind", "name").agg(F.min("seq").alias("seq"))
    x = written(x.withColumns({"norm": N.norm_entity(F.col("name")), "core": N.norm_company(F.col("name"))}))
    forms = x.select("project_id", "kind", "norm", "core").where("norm <> ''").distinct()
    within = ["project_id", "kind"]
    node = lambda tag, c: F.concat_ws("\u0001", *within, F.lit(tag), c)
    generic, weak = (F.array(*[F.lit(w) for w in words]) for words in (vocab.GENERIC_ORG_WORDS, vocab.WEAK_COMPANY_WORDS))

    def starts(w):
        """Beginnings without the generic words behind them."""
        kept = F.coalesce(F.array_max(F.transform(w, lambda v, i: F.when(~F.array_contains(generic, v), i + 1))), F.lit(0))
        cut = F.filter(F.sequence(F.lit(1), F.size(w)), lambda k: (k >= kept) & (k < F.size(w)) & ~((k == 1) & F.array_contains(weak, F.get(w, F.lit(0)))))
        return F.when(F.size(w) > 1, F.transform(cut, lambda k: F.array_join(F.slice(w, 1, k), " "))).otherwise(F.array().cast("array<string>"))

    def ends(w):
        cut = F.when(F.size(w) > 2, F.sequence(F.lit(2), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(cut, lambda k: F.array_join(F.slice(w, -k, k), " "))

    links = forms.where("core <> ''").select(node("n", F.col("norm")).alias("a"), node("c", F.col("core")).alias("b"))
    for tag, c, shorter in (("c", "core", starts), ("n", "norm", ends)):
        own = forms.where(F.col(c) != "").select(*within, c).distinct()
        made = own.select(*within, c, F.explode(N.bind(shorter, N.words(F.col(c)))).alias("form"))
        there = made.join(own.withColumnRenamed(c, "form"), [*within, "form"], "left_semi")
        links = links.union(there.select(node(tag, F.col(c)), node(tag, F.col("form"))))
    label = connected_components(links).withColumnRenamed("node", "at")
    alone = F.concat(node("n", F.col("norm")), F.when(F.col("norm") == "", F.col("name")).otherwise(""))
    placed = written(x.withColumn("at", alone).join(label, "at", "left").withColumn("firm", F.coalesce("component", "at")))
    formal = N.company_core(F.col("name")) != N.norm_key(F.col("name"))
    first = [F.length("name").alias("length"), (-F.col("seq")).alias("first"), F.col("name").alias("name")]
    best = placed.groupBy(*within, "firm").agg(F.max(F.struct(formal.alias("formal"), *first))["name"].alias("best"), F.max(F.struct(*first))["name"].alias("longest"))
    best = best.select(*within, "firm", N.preferred(F.col("best"), F.col("longest")).alias("canonical"))
    return placed.join(best, [*within, "firm"]).select(*within, "name", "canonical")
