"""Queries on extraction responses."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import vocab
from kgloom.operators import extraction as X
from kgloom.plans import core
from kgloom.plans import sqltext as S
from kgloom.plans.core import query_into
from kgloom.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
query = query_into(QUERIES, ORACLE_SQL)

#: Items of the responses, in their order: ends of the noisy triplets, and for some orders a root, a volume and a section.
ITEMS = """
select project_id, document_id, concat('c', cast(seq div 8 as string)) as chunk_id, seq div 8 as ok, seq * 4 as place, source_node as name, case when source_type = 'company' then 'TestRecord' else source_type end as type, description from raw union all
select project_id, document_id, concat('c', cast(seq div 8 as string)), seq div 8, seq * 4 + 1, destination_node, case when destination_type = 'country' then 'ManufacturingLocation' else destination_type end, '' from raw union all
select project_id, document_id, concat('c', cast(seq div 8 as string)), seq div 8, seq * 4 + 2, case seq % 3 when 0 then 'UL LLC' when 1 then 'Vol. 3' else ' sec 4' end, case seq % 3 when 0 then 'Org' when 1 then 'Volume' else 'section' end, 'One. Two.' from raw where (seq div 8) % 5 = 0
"""
SQL_ITEMS = ITEMS.replace("seq div 8", "seq // 8").replace("as string", "as varchar")
#: Every 37th response is cut off in the middle.
READABLE = "ok % 37 <> 0"


def responses(spark, d) -> DataFrame:
    raw = core.raw(spark, d)
    esc = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    text = lambda names, cs: F.concat(*[x for i, (n, c) in enumerate(zip(names, cs, strict=True)) for x in (F.lit(('{"' if i == 0 else '","') + n + '":"'), esc(c))], F.lit('"}'))
    joined = lambda rows: F.array_join(F.transform(F.sort_array(rows), lambda x: x["j"]), ",")

    def item(place, name, type_, description):
        return F.struct(place.alias("place"), name.alias("name"), type_.alias("type"), description.alias("description"), text(("name", "type", "description"), (name, type_, description)).alias("j"))

    def items(r):
        n, last = r["seq"] * 4, r["seq"] % 3
        ends = F.array(
            item(n, r["source_node"], F.when(r["source_type"] == "company", "TestRecord").otherwise(r["source_type"]), r["description"]),
            item(n + 1, r["destination_node"], F.when(r["destination_type"] == "country", "ManufacturingLocation").otherwise(r["destination_type"]), F.lit("")),
        )
        name = F.when(last == 0, "UL LLC").when(last == 1, "Vol. 3").otherwise(" sec 4")
        return F.when(F.floor(r["seq"] / 8) % 5 == 0, F.concat(ends, F.array(item(n + 2, name, F.when(last == 0, "Org").when(last == 1, "Volume").otherwise("section"), F.lit("One. Two."))))).otherwise(ends)

    def relation(r):
        keywords = F.concat(r["relationship"], F.lit(", "), r["keywords"])
        return F.struct(r["seq"].alias("seq"), r["source_node"].alias("source_node"), r["destination_node"].alias("destination_node"), keywords.alias("keywords"), text(("source", "target", "keywords", "description"), (r["source_node"], r["destination_node"], keywords, r["description"])).alias("j"))

    # rows are dealt once and as they are; what is made of them is larger
    key = ["project_id", "document_id", "ok"]
    held = F.collect_list(F.struct("seq", "source_type", "source_node", "relationship", "destination_type", "destination_node", "description", "keywords")).alias("rows")
    both = raw.withColumn("ok", F.expr("seq div 8")).groupBy(key).agg(held).withColumns({"e": joined(F.flatten(F.transform("rows", items))), "r": joined(F.transform("rows", relation))})
    whole = F.concat(F.lit('Here it is: ```json {"entities":['), "e", F.lit('],"relationships":['), "r", F.lit("]}"))
    return both.select("project_id", "document_id", F.concat(F.lit("c"), F.col("ok").cast("string")).alias("chunk_id"), F.when(F.expr(READABLE), F.concat(whole, F.lit("\n```"))).otherwise(F.substring(whole, 1, 90)).alias("response"))


def _type(x: str) -> str:
    snake = rf"regexp_replace({x}, '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    clean = rf"trim(regexp_replace(lower(trim(regexp_replace({snake}, '[^a-zA-Z0-9_\s]', '', 'g'))), '\s+', '_', 'g'), '_')"
    return f"case when {S.case(vocab.EXTRACTION_ALIASES, clean)} in ({S.quoted(vocab.EXTRACTION_TYPES)}) then {S.case(vocab.EXTRACTION_ALIASES, clean)} else 'entity' end"


def _numbered(x: str, word: str, short: str) -> str:
    n = rf"regexp_extract(trim({x}), '(?i)^(?:{short}(?:{word[len(short):]})?)\.?\s*(\d+)\s*$', 1)"
    return f"case when {n} = '' then trim({x}) else '{word.title()} ' || {n} end"


E = f"""{S.RAW}, items as ({SQL_ITEMS}), typed as (select *, {_type("type")} as t, {S.root("name")} as is_root from items where {READABLE} and trim(name) <> ''),
e as (select project_id, document_id, chunk_id, cast(row_number() over (partition by project_id, document_id, chunk_id order by place, items.name, items.type, items.description) - 1 as int) as pos,
  case when t = 'volume' then {_numbered("name", "volume", "vol")} when t = 'section' then {_numbered("name", "section", "sec")} when t = 'ul' or is_root then 'UL Solutions' else trim(name) end as name,
  case when t not in ('volume', 'section') and is_root then 'ul' else t end as entity_type, {S.short("description")} as description from typed items)"""


@query(f"with {E} select * from e")
def ext_entities(spark, d):
    return X.entities(responses(spark, d))


@query(f"with {S.RAW}, items as ({SQL_ITEMS}) select document_id, chunk_id, count(*) filter (true) as n from items where {READABLE} group by 1, 2")
def ext_parse_json(spark, d):
    return X.readable(responses(spark, d)).select("document_id", "chunk_id", F.size("entities").cast("long").alias("n"))


@query(f"with {S.RAW}, items as ({SQL_ITEMS}) select distinct type, {_type('type')} as entity_type from items")
def ext_entity_type(spark, d):
    raw = core.raw(spark, d)
    return spark.sql(ITEMS.replace("from raw", "from {raw}"), raw=raw).select("type", X.entity_type(F.col("type")).alias("entity_type")).distinct()


def _relation(k: str, a: str, b: str) -> str:
    raw = f"replace(lower(trim({k})), '-', '_')"
    clean = lambda x: rf"trim(regexp_replace(trim({x}), '\s+', '_', 'g'), '_')"
    tokens = f"list_filter(list_append(list_transform(regexp_split_to_array({raw}, '[,;/|]+'), lambda x: {clean('x')}), {clean(raw)}), lambda x: x <> '')"
    known = f"list_filter(list_transform({tokens}, lambda x: {S.case(vocab.RELATION_ALIASES, 'x')}), lambda x: x in ({S.quoted(vocab.RELATION_NAMES)}))"
    return f"coalesce({known}[1], {S.case(X.PAIR_RELATION, f'{a} || chr(124) || {b}', 'null')}, {tokens}[1], 'related_to')"


@query(f"with {S.RAW} select seq, {_relation('relationship || chr(44) || keywords', S.type_of('source_type'), S.type_of('destination_type'))} as relation from raw")
def ext_rel_keywords(spark, d):
    from kgloom.operators import triplets as T

    return core.raw(spark, d).select("seq", X.relation_of_keywords(F.concat_ws(",", "relationship", "keywords"), T.type_of(F.col("source_type")), T.type_of(F.col("destination_type"))).alias("relation"))


def _fits(end: str, other: str) -> str:
    return f"case when len({end}_all) = 1 then {end}_all[1] when {other} is not null and len(list_filter({end}_all, lambda x: (x.entity_type || '|' || {other}) in ({S.quoted(X.PAIRS)}))) = 1 then list_filter({end}_all, lambda x: (x.entity_type || '|' || {other}) in ({S.quoted(X.PAIRS)}))[1] end"


def _all(end: str) -> str:
    of = lambda v, f="name": f"list_filter(entities, lambda x: x.{f} = {v})"
    by_number = f"list_concat({of(_numbered(end, 'volume', 'vol'))}, {of(_numbered(end, 'section', 'sec'))})"
    return f"case when len({of(end)}) > 0 then {of(end)} when len({by_number}) > 0 then {by_number} else {of(S.key(end), 'key')} end as {end}_all"


@query(f"""with {E}, g as (select project_id, document_id, chunk_id, list({{'name': name, 'entity_type': entity_type, 'key': {S.key("name")}}} order by pos) as entities from e group by 1, 2, 3),
r as (select project_id, document_id, 'c' || (seq // 8) as chunk_id, cast(row_number() over (partition by project_id, document_id, seq // 8 order by seq, source_node, destination_node, concat(relationship, ', ', keywords)) - 1 as int) as pos, trim(source_node) as source, trim(destination_node) as target, trim(concat(relationship, ', ', keywords)) as keywords, {S.short("description")} as evidence from raw where (seq // 8) % 37 <> 0),
a as (select *, {_all("source")}, {_all("target")} from r join g using (project_id, document_id, chunk_id) where source <> '' and target <> ''),
b as (select *, case when len(source_all) = 1 then source_all[1].entity_type end as s0 from a), c as (select *, {_fits("target", "s0")} as t from b), f as (select *, t.entity_type as t0 from c), h as (select *, {_fits("source", "t0")} as s from f),
k as (select *, coalesce(s.entity_type, 'entity') as source_type, coalesce(t.entity_type, 'entity') as destination_type from h)
select project_id, document_id, chunk_id, pos, coalesce(s.name, source) as source_node, source_type, coalesce(t.name, target) as destination_node, destination_type, keywords, evidence, {_relation("keywords", "source_type", "destination_type")} as relationship from k""")
def ext_relationships(spark, d):
    return X.relationships(responses(spark, d))


@query(f"with {E}, n as (select project_id, document_id, chunk_id, count(*) as n from e group by 1, 2, 3), m as (select document_id, 'c' || (seq // 8) as chunk_id, count(*) as m from raw group by 1, 2) select n.document_id, n.chunk_id, cast(n as int) as entities, cast(m as int) as relationships, n >= 40 or n + m >= 80 as at_cap from n join m using (document_id, chunk_id)")
def ext_continuation(spark, d):
    return X.at_cap(responses(spark, d)).drop("project_id")


@query(rf"select doc_id, regexp_matches(text, '{vocab.APPLICANT_CUES}') as applicant, regexp_matches(text, '{vocab.MANUFACTURER_CUES}') as manufacturer from (select doc_id, text || case doc_id % 4 when 0 then ' filed an application' when 1 then ' Manufactured  by x' when 2 then ' certificate holder, manufacturers of y' else '' end as text from documents)")
def ext_role_cues(spark, d):
    tail = F.when(F.col("doc_id") % 4 == 0, " filed an application").when(F.col("doc_id") % 4 == 1, " Manufactured  by x").when(F.col("doc_id") % 4 == 2, " certificate holder, manufacturers of y").otherwise("")
    text = F.concat("text", tail)
    return adapters.read(spark, d, "documents").select("doc_id", text.rlike(vocab.APPLICANT_CUES).alias("applicant"), text.rlike(vocab.MANUFACTURER_CUES).alias("manufacturer"))


@query(f"""with {S.RAW}, n as (select distinct destination_node as name from raw union select distinct source_node from raw union select upper(destination_type) from raw union select 'Global' union select 'UL LLC' union select '.;' union select 'Safety' union select 'UN 38' union select 'Acme and'), c as (select name, {S.clean_company("name")} as clean from n)
select name, {S.plausible("clean")} as plausible from c""")
def ext_plausible_company(spark, d):
    r = core.raw(spark, d)
    names = r.select("destination_node").union(r.select("source_node")).union(r.select(F.upper("destination_type"))).distinct().union(spark.sql("select * from values ('Global'), ('UL LLC'), ('.;'), ('Safety'), ('UN 38'), ('Acme and')")).distinct()
    return names.select(F.col("destination_node").alias("name"), X.plausible_company(F.col("destination_node")).alias("plausible"))
