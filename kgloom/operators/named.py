"""Values of names, computed once for each distinct name instead of once for each row."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.operators.components import written

#: A table of so many rows at most is sent to every executor; a larger one meets its rows by shuffle.
SMALL = 200_000
ENDS = (("s", "source"), ("d", "destination"))


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= SMALL else table


def with_ends(t: DataFrame, **values: Callable[[Column, Column], Column]) -> DataFrame:
    """``t`` with columns ``s_<value>`` and ``d_<value>``: a function of type and name of either end. Null counts as empty."""
    x = t.withColumns({f"{a}_{c}": F.coalesce(F.col(f"{a}_{c}"), F.lit("")) for _, a in ENDS for c in ("type", "node")})
    pair = lambda a: F.struct(F.col(f"{a}_type").alias("_type"), F.col(f"{a}_node").alias("_name"))
    pairs = x.select(F.inline(F.array(pair("source"), pair("destination")))).distinct()
    table = small(written(pairs.select("_type", "_name", *[f(F.col("_type"), F.col("_name")).alias(k) for k, f in values.items()])))
    for p, a in ENDS:
        x = x.join(table.select(F.col("_type").alias(f"{a}_type"), F.col("_name").alias(f"{a}_node"), *[F.col(k).alias(f"{p}_{k}") for k in values]), [f"{a}_type", f"{a}_node"])
    return x


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (low, …) joined with the ``texts`` (text) that they contain.

    A text meets names by the rarest of its three-character strings, counted over the names, so what many names share brings nobody
    together; texts of one or two characters meet by themselves. What meets is then verified. A text with a string that no name has is dropped at once.
    """
    asked = texts.select("text").where("text <> ''").distinct()
    # by characters once, as to find a place in a string of many bytes takes as long as it is
    pieces = lambda x, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.lit(n)), ""))
    cut = lambda c, n: N.bind(lambda x: pieces(x, n), F.split(c, ""))
    grams = written(asked.select("text", F.explode(F.when(F.length("text") < 3, F.array("text")).otherwise(F.array_distinct(cut("text", 3)))).alias("start")))
    sought = small(written(grams.select("start").distinct()))
    few = grams.where("length(start) < 3").isEmpty()
    every = F.array_distinct(cut("low", 3) if few else F.flatten(F.array(*[cut("low", n) for n in (1, 2, 3)])))
    met = names.withColumn("start", F.explode(every)).join(sought, "start", "left_semi")
    often = small(written(met.groupBy("start").agg(F.count("*").alias("n"))))
    rarest = grams.join(often, "start", "left").groupBy("text").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min_by("start", F.struct("n", "start")).alias("start"))
    chosen = small(written(rarest.where("missing = 0").select("text", "start")))
    return names.withColumn("start", F.explode(every)).join(chosen, "start").where(F.contains("low", "text")).drop("start")


def sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ``a, b`` of rows (a, key) and (b, key) that have a key in common.

    Ends of the same keys are one class; classes meet by keys and are made distinct, and then stand for their members, so a pair is
    made once and not for each key that it shares. Pairs are neither shuffled nor counted.
    """

    def classes(x: DataFrame, end: str, name: str) -> tuple[DataFrame, DataFrame]:
        x = written(x.select(end, "key").where(F.col(end).isNotNull() & F.col("key").isNotNull()).distinct())
        members = written(x.groupBy(end).agg(F.sha2(F.to_json(F.array_sort(F.collect_list("key"))), 256).alias(name)))
        # one member's keys are those of its class
        one = members.groupBy(name).agg(F.min(end).alias(end))
        return members, x.join(one, end).select(name, "key")

    (a, a_keys), (b, b_keys) = classes(left, "a", "a_class"), classes(right, "b", "b_class")
    met = written(a_keys.join(b_keys, "key").select("a_class", "b_class").distinct())
    dealt = written(met.join(b, "b_class").select("a_class", "b")).repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "a_class")
    return dealt.join(small(a), "a_class").select("a", "b")
