"""Extraction responses as typed rows. One response is one row, and all of it is decided within that row: nothing is shuffled.

Responses: project_id, document_id, chunk_id, response (text). A response that is no JSON object gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab

ENTITY = "struct<name:string,type:string,description:string>"
RELATION = "struct<source:string,target:string,keywords:string,description:string>"
ID = ("project_id", "document_id", "chunk_id")
PAIRS = sorted({f"{a}|{b}" for s, _, d in vocab.RULES for a, b in ((s, d), (d, s))})
PAIR_RELATION = {f"{s}|{d}": r for s, r, d in vocab.RULES}


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace, as text; null if there is none. What is before and behind, like fences, goes."""
    raw = F.coalesce(c, F.lit(""))
    start, behind = F.instr(raw, "{"), F.length(F.substring_index(raw, "}", -1))
    size = F.length(raw) - behind - start + 1
    return F.when((start > 0) & (size > 1), F.substring(raw, start, size))


def entity_type(c: Column) -> Column:
    """The known type that a written type stands for, else ``entity``."""

    def clean(raw):
        snake = F.regexp_replace(raw, r"([a-z0-9])([A-Z])", "$1_$2")
        return F.when(raw.rlike(r"^[a-z]+\z"), raw).otherwise(F.btrim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(snake, r"[^a-zA-Z0-9_\s]", ""))), r"\s+", "_"), F.lit("_")))

    known = {t: t for t in vocab.EXTRACTION_TYPES} | {k: v if v in vocab.EXTRACTION_TYPES else "entity" for k, v in vocab.EXTRACTION_ALIASES.items()}
    return N.lookup(known, N.bind(clean, F.coalesce(c, F.lit(""))), F.lit("entity"))


def numbered(c: Column, word: str, short: str) -> Column:
    """``Word n`` for any way to write it, else the trimmed text."""
    number = F.regexp_extract(N.text(c), rf"(?i)^(?:{short}(?:{word[len(short):]})?)\.?\s*(\d+)\s*$", 1)
    return F.when(number == "", N.text(c)).otherwise(F.concat(F.lit(word.title() + " "), number))


def relation_of_keywords(keywords: Column, source: Column, target: Column) -> Column:
    """The first keyword that names a relation, else that of the pair of types, else the first keyword, else ``related_to``."""
    clean = lambda x: F.btrim(F.regexp_replace(F.trim(x), r"\s+", "_"), F.lit("_"))
    split = lambda raw: F.filter(F.concat(F.transform(F.split(raw, "[,;/|]+"), clean), F.array(clean(raw))), lambda x: x != "")
    known = lambda tokens: F.filter(F.transform(tokens, lambda x: N.lookup(vocab.RELATION_ALIASES, x)), lambda x: x.isin(*vocab.RELATION_NAMES))
    pair = F.create_map(*[F.lit(v) for kv in PAIR_RELATION.items() for v in kv])[F.concat_ws("|", source, target)]
    tokens = N.bind(split, F.replace(F.lower(N.text(keywords)), F.lit("-"), F.lit("_")))
    return N.bind(lambda t, by_pair: F.coalesce(F.get(known(t), F.lit(0)), by_pair, F.get(t, F.lit(0)), F.lit("related_to")), tokens, pair)


def _entity(x: Column) -> Column:
    def typed(kind, name, key):
        return N.bind(shown, kind, name, key, (kind == "ul") | N.is_root_key(key))

    def shown(kind, name, key, root):
        place = F.when(kind == "volume", numbered(name, "volume", "vol")).otherwise(numbered(name, "section", "sec"))
        plain = F.struct(F.when(root, "UL Solutions").otherwise(name).alias("name"), F.when(root, "ul").otherwise(kind).alias("entity_type"), F.when(root, "ul solutions").otherwise(key).alias("key"))
        return F.when(kind.isin("volume", "section"), N.bind(lambda p: F.struct(p.alias("name"), kind.alias("entity_type"), N.norm_key(p).alias("key")), place)).otherwise(plain)

    def whole(e):
        return F.struct(e["name"].alias("name"), e["entity_type"].alias("entity_type"), e["key"].alias("key"), N.text(x["description"]).alias("description"))

    return N.bind(whole, N.bind(typed, entity_type(F.coalesce(x["type"], F.lit("entity"))), N.text(x["name"]), N.norm_key(x["name"])))


def readable(responses: DataFrame) -> DataFrame:
    """``entities`` that have a name, as they are written, and ``relationships`` of each readable response."""
    j = F.from_json(json_object(F.col("response")), f"entities array<{ENTITY}>, relationships array<{RELATION}>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    # as rows of a generator, so that the condition isn't moved below, where each response would be made and parsed once more for each use of it
    x = responses.select(*ID, F.explode(F.array(j)).alias("j")).where("j is not null and j._corrupt is null")
    named = F.filter(F.coalesce("j.entities", F.array().cast(f"array<{ENTITY}>")), lambda e: N.text(e["name"]) != "")
    return x.select(*ID, named.alias("entities"), F.coalesce("j.relationships", F.array().cast(f"array<{RELATION}>")).alias("relationships"))


def parsed(responses: DataFrame) -> DataFrame:
    """As ``readable``, with entities in normal form: name, entity_type, key, description."""
    return readable(responses).select(*ID, F.transform("entities", _entity).alias("entities"), "relationships")


def entities(responses: DataFrame) -> DataFrame:
    """One row for each entity: name, type, description, and its place in the response."""
    return N.with_short_description(parsed(responses).select(*ID, F.posexplode("entities").alias("pos", "e")).select(*ID, "pos", "e.name", "e.entity_type", "e.description"), "description")


def relationships(responses: DataFrame) -> DataFrame:
    """One row for each relationship, its ends typed by the entities of the same response.

    An end is looked up by exact name, then as a volume or section, then by normal form; of several entities the one
    whose type may stand with the other end's is taken, if it is the only one.
    """
    x = parsed(responses).select(*ID, "entities", F.posexplode("relationships").alias("pos", "r"))
    x = x.select(*ID, "pos", "entities", N.text(F.col("r.source")).alias("source"), N.text(F.col("r.target")).alias("target"), N.text(F.col("r.keywords")).alias("keywords"), N.text(F.col("r.description")).alias("evidence"))
    x = x.where("source <> '' and target <> ''")
    of = lambda value, field="name": F.filter("entities", lambda e: e[field] == value)
    for end in ("source", "target"):
        c = F.col(end)
        by_number = N.bind(lambda v, s: F.concat(of(v), of(s)), numbered(c, "volume", "vol"), numbered(c, "section", "sec"))
        otherwise = lambda found, c=c: F.when(F.size(found) > 0, found).otherwise(N.bind(lambda k: of(k, "key"), N.norm_key(c)))
        x = x.withColumn(f"{end}_all", N.bind(lambda found, by_number=by_number, otherwise=otherwise: F.when(F.size(found) > 0, found).otherwise(N.bind(otherwise, by_number)), of(c)))
    none = F.lit(None).cast("string")
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))

    def pick(end: str, other: Column) -> Column:
        fits = F.filter(f"{end}_all", lambda e: F.concat_ws("|", e["entity_type"], other).isin(*PAIRS))
        return F.coalesce(only(F.col(f"{end}_all")), F.when(other.isNotNull(), only(fits)))

    x = x.withColumn("s0", only(F.col("source_all"))).withColumn("t", pick("target", F.coalesce(F.col("s0.entity_type"), none))).withColumn("s", pick("source", F.coalesce(F.col("t.entity_type"), none)))
    kind = lambda c: F.coalesce(F.col(f"{c}.entity_type"), F.lit("entity"))
    x = x.select(*ID, "pos", F.coalesce("s.name", "source").alias("source_node"), kind("s").alias("source_type"), F.coalesce("t.name", "target").alias("destination_node"), kind("t").alias("destination_type"), "keywords", "evidence")
    return N.with_short_description(x.withColumn("relationship", relation_of_keywords(F.col("keywords"), F.col("source_type"), F.col("destination_type"))), "evidence")


def at_cap(responses: DataFrame) -> DataFrame:
    """Responses that may have been cut: as many entities, or rows in all, as one may have."""
    n, m = F.size("entities"), F.size("relationships")
    return readable(responses).select(*ID, n.alias("entities"), m.alias("relationships"), ((n >= vocab.MOST_ENTITIES) | (n + m >= vocab.MOST_RECORDS)).alias("at_cap"))


def with_continuation(first: DataFrame, more: DataFrame) -> DataFrame:
    """Entities of the first response and those of a second one that are new by type and normal form."""
    key = [*ID, "entity_type", "key"]
    a, b = (x.withColumn("key", N.norm_key(F.col("name"))) for x in (first, more))
    new = b.join(a.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(F.struct("pos", "name", "description")).alias("e"))
    return first.select(*ID, "entity_type", "name", "description").union(new.select(*ID, "entity_type", "e.name", "e.description"))


def sections(responses: DataFrame) -> DataFrame:
    """Texts of ``{"sections": [text or {"text": …}]}`` responses, with their place; empty ones go."""
    body = json_object(F.col("response"))
    list_ = F.from_json(F.get_json_object(body, "$.sections"), "array<string>")
    x = responses.select(*ID, F.posexplode(list_).alias("pos", "item"))
    text = F.when(F.col("item").rlike(r"^\s*\{"), F.get_json_object("item", "$.text")).otherwise(F.col("item"))
    return x.select(*ID, "pos", F.trim(F.coalesce(text, F.lit(""))).alias("text")).where("text <> ''")


def clean_company(c: Column) -> Column:
    """A name as written, without what a rights line adds, marks at its ends, and a last ``and``."""
    clean = F.btrim(F.regexp_replace(F.regexp_replace(N.text(c), vocab.RIGHTS, ""), r"\s+", " "), F.lit(" ,.;:|-"))
    return F.btrim(F.regexp_replace(clean, r"(?i)\s+and$", ""), F.lit(" ,.;:"))


def plausible_company(name: Column) -> Column:
    """Not the root, no standard's number, no generic or weak word alone, no word that names nobody."""

    def test(clean):
        unnamed = F.lower(clean).isin(*vocab.UNNAMED_WORDS)
        return (F.length(clean) >= 2) & ~N.is_root(clean) & ~clean.rlike(vocab.NUMBERED_BODIES) & ~N.norm_company(clean).isin("ul", "ul solutions") & ~unnamed & ~N.is_generic_org(clean)

    return N.bind(test, clean_company(name))
