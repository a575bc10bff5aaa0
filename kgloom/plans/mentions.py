"""Queries on firms that texts name and the roles that texts speak for."""

from pyspark.sql import functions as F

from kgloom.functions import vocab
from kgloom.operators import firms as firms_
from kgloom.operators import mentions as M
from kgloom.operators.components import written
from kgloom.plans import core
from kgloom.plans import sqltext as S
from kgloom.plans.core import query_into
from kgloom.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
query = query_into(QUERIES, ORACLE_SQL)

#: Every document as a chunk that ends by naming a firm in one of eight ways.
CHUNKS = """select source as project_id, doc_id as document_id, concat('c', cast(doc_id as string)) as chunk_id, doc_id as seq, concat(source, '-', cast(doc_id % 3 as string), '.pdf') as source_file,
  concat(coalesce(text, ''), case doc_id % 8 when 0 then concat(' Copyright © 2021 Firm', cast(doc_id % 41 as string), ' Inc. All rights reserved.') when 1 then concat(' Testing conducted by FIRM', cast(doc_id % 41 as string), ' Ltd in May. Copyright Firm', cast(doc_id % 41 as string), '.')
  when 2 then concat(' Firm', cast(doc_id % 41 as string), ' products comply. Firm', cast(doc_id % 41 as string), ' GmbH products too, Our products.') when 3 then concat(' Guide - Firm', cast(doc_id % 41 as string), ' Support (IN). Copyright (c) 2019-2021 Firm', cast(doc_id % 41 as string), ' Displays Co. All rights reserved')
  when 4 then concat(' Applicant: Firm', cast(doc_id % 41 as string), ' Corp. filed an application.') when 5 then concat(' Made for firm-', cast(doc_id % 41 as string), ' and firm', cast(doc_id % 41 as string), '.')
  when 6 then concat(' Cells manufactured by Firm', cast(doc_id % 41 as string), '.') else ' The standard products of all. Copyright UL Solutions. Copyright UN 38 and.' end) as text from {documents}"""
#: Firms of each source, as applicants, companies or brands, and links that give them roles.
FIRMS = """select project_id, k as seq, concat('Firm', cast(k as string), case k % 4 when 0 then ' Inc' when 1 then ' Co., Ltd.' else '' end) as name, case k % 3 when 0 then 'Applicant' when 1 then 'company' else 'brand' end as entity_type,
  case k % 5 when 0 then '' else concat('Firm of ', project_id, '.') end as description, k % 7 = 0 as known from (select distinct source as project_id, doc_id % 43 as k from {documents})
  union all select distinct source, 100 + doc_id % 43, concat('FIRM-', cast(doc_id % 43 as string)), case doc_id % 2 when 0 then 'applicant' else 'product' end, 'Again.', false from {documents}"""
LINKS = """select source as project_id, doc_id as seq, case doc_id % 3 when 0 then 'ul' when 1 then 'component' else 'applicant' end as source_type, case doc_id % 3 when 0 then 'UL' when 1 then concat('Cell ', cast(doc_id as string)) else concat('Firm', cast(doc_id % 41 as string), ' Ltd') end as source_node,
  case doc_id % 3 when 0 then 'Has Applicant' when 1 then 'manufactured-by' else 'has_product' end as relationship, case doc_id % 3 when 0 then 'Applicant' when 1 then 'company' else 'product' end as destination_type,
  case doc_id % 3 when 2 then 'Phone' else concat('firm', cast(doc_id % 41 as string)) end as destination_node, case doc_id % 10 when 1 then 'It is manufactured  by them.' else 'Linked.' end as description from {documents}"""
_sql = lambda s: adapters.as_sql(s).replace("as string)", "as varchar)")


def chunks(spark, d):
    return adapters.fixture(spark, d, CHUNKS)


def firms(spark, d):
    return adapters.fixture(spark, d, FIRMS).withColumn("kinds", F.when(F.col("known"), F.array(F.lit("support"), F.lit("cover")))).drop("known")


def links(spark, d):
    return adapters.fixture(spark, d, LINKS)


def _cue(i: int, kind: str, flags: str, phrase: str, after: str) -> str:
    # without look-ahead: what must follow is matched too, outside the groups
    pattern = ("(?i)" if flags else "") + f"({phrase})" + (f"(?:{after})" if after else "")
    pattern = pattern.replace("'", "''")
    both = f"list_zip(regexp_extract_all(text, '{pattern}', 1), regexp_extract_all(text, '{pattern}', 2))"
    return f"select project_id, document_id, chunk_id, seq, source_file, {i} as cue, '{kind}' as kind, unnest({both}) as h, generate_subscripts({both}, 1) as j from chunks"


MENTIONS = rf"""chunks as ({_sql(CHUNKS)}), hits as ({" union all ".join(_cue(i, *c) for i, c in enumerate(vocab.FIRM_CUES))}),
cleaned as (select * exclude (h), cue * 1000000 + j as pos, trim(regexp_replace(h[1], '\s+', ' ', 'g')) as evidence, {S.clean_company("h[2]")} as name from hits),
keyed as (select *, {S.company("name")} as key from cleaned where {S.plausible("name")}),
ranked as (select *, trim(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) <> key as formal from keyed where key <> ''),
mentions as (select project_id, document_id, chunk_id, key, min(seq) as seq, min(source_file) as source_file, min(pos) as pos, (list(name order by formal desc, length(name) desc, pos))[1] as name,
  list_reduce(list_prepend('', list(evidence order by pos)), lambda a, e: case when contains(a, e) then a when a = '' then e else a || ' | ' || e end) as evidence, list_sort(list(distinct (cue, kind))) as cues from ranked group by 1, 2, 3, 4)"""


@query(f"with {MENTIONS} select project_id, document_id, chunk_id, key, name, evidence, array_to_string(list_transform(cues, lambda c: c[2]), ',') as kinds from mentions")
def ext_company_mentions(spark, d):
    m = M.company_mentions(chunks(spark, d))
    return m.select("project_id", "document_id", "chunk_id", "key", "name", "evidence", F.array_join("kinds", ",").alias("kinds"))


MERGED = f"""{MENTIONS}, firms as ({_sql(FIRMS)}), ents as (select * exclude (known), case when known then ['support', 'cover'] else [] end as kinds, case when lower(trim(entity_type)) in ('company', 'applicant', 'brand') then {S.core("name")} else '' end as core from firms),
own as (select * from ents where core <> '' qualify row_number() over (partition by project_id, core order by seq, name) = 1),
r as (select project_id, core, -1 as seq, 0 as pos, name, description, kinds from own union all select project_id, {S.core("name")}, seq, pos, name, evidence, list_transform(cues, lambda c: c[2]) from mentions where {S.core("name")} <> ''),
said as (select project_id, core, row_number() over (partition by project_id, core order by seq, pos) as seq, name, description, '' as keywords, kinds from r),
"""
# of evidence between bars the shortest part speaks
_part = "list_sort(list_transform(string_split(description, ' | '), lambda p, i: {'n': length(trim(p)), 'i': i, 'p': trim(p)}))[1].p"
_shaped = f"""parted as (select *, {_part} as part from said), shaped as (select *, {S.short("part")} as form from parted), picked as (select project_id, core, count(*) as n, (list(name order by {S.core("name")} <> {S.key("name")} desc, length(name) desc, seq))[1] as name,
  case when count(*) filter (form <> '') = 1 and arg_min(form, seq) <> '' then arg_min(description, seq) else coalesce((list(form order by length(form), seq desc) filter (form <> ''))[1], '') end as description from shaped group by 1, 2),
kinded as (select project_id, core, list(kind order by seq, i) as kinds from (select project_id, core, kind, seq, i from (select project_id, core, seq, unnest(kinds) as kind, generate_subscripts(kinds, 1) as i from said) qualify row_number() over (partition by project_id, core, kind order by seq, i) = 1) group by 1, 2),
merged as (select e.project_id, e.seq, case when p.n > 1 then p.name else e.name end as name, e.entity_type, case when p.n > 1 then p.description else e.description end as description, case when p.n > 1 then k.kinds else e.kinds end as kinds, e.core
  from ents e left join own o on o.project_id = e.project_id and o.seq = e.seq and o.core = e.core left join picked p on p.project_id = o.project_id and p.core = o.core left join kinded k on k.project_id = o.project_id and k.core = o.core
  union all select p.project_id, null, p.name, 'company', p.description, k.kinds, p.core from picked p join kinded k on k.project_id = p.project_id and k.core = p.core where not exists (select 1 from own o where o.project_id = p.project_id and o.core = p.core))"""
MERGED += _shaped


def merged(spark, d):
    return M.merged_mentions(written(M.company_mentions(chunks(spark, d))), firms(spark, d))


_kinds = "array_to_string(coalesce(kinds, []), ',') as kinds"


@query(f"with {MERGED} select project_id, seq, name, entity_type, description, {_kinds} from merged")
def ext_merge_mentions(spark, d):
    return merged(spark, d).select("project_id", "seq", "name", "entity_type", "description", F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


def _spoken(of: str) -> str:
    return f"""texts as (select project_id, {S.key("text")} as low, regexp_matches(text, '{vocab.APPLICANT_CUES}') as applicant, regexp_matches(text, '{vocab.MANUFACTURER_CUES}') as manufacturer from chunks),
spoken as (select c.project_id, c.core, bool_or(applicant) as applicant, bool_or(manufacturer) as manufacturer from (select distinct project_id, core from {of} where core <> '') c join texts t on t.project_id = c.project_id and contains(t.low, c.core) group by 1, 2)"""


# of all firms, before texts add kinds, so that some have none that speaks for an owner
DEMOTED = f"""chunks as ({_sql(CHUNKS)}), firms as ({_sql(FIRMS)}), ents as (select * exclude (known), case when known then ['support', 'cover'] else [] end as kinds, {S.core("name")} as core from firms),
asked as (select * from ents where lower(trim(entity_type)) = 'applicant'), {_spoken("asked")},
judged as (select e.*, lower(trim(entity_type)) = 'applicant' and s.core is not null and not s.applicant and not list_has_any(kinds, ['copyright', 'testing_by', 'products', 'support']) as demoted from ents e left join spoken s on s.project_id = e.project_id and s.core = e.core),
gone as (select distinct project_id, core from judged where demoted)"""


@query(f"""with {DEMOTED}, links as ({_sql(LINKS)}), l as (select *, {S.core("source_node")} as sc, {S.core("destination_node")} as dc from links),
flagged as (select l.*, a.core is not null as sg, b.core is not null as dg from l left join gone a on a.project_id = l.project_id and a.core = sc left join gone b on b.project_id = l.project_id and b.core = dc)
select 'entity' as what, project_id, seq, name, case when demoted then 'company' else entity_type end as kind, array_to_string(case when demoted then list_append(kinds, 'demoted_applicant') else kinds end, ',') as other from judged
union all select 'triplet', project_id, seq, source_node || ' ' || destination_node, case when sg and lower(trim(source_type)) = 'applicant' then 'company' else source_type end, case when dg and lower(trim(destination_type)) = 'applicant' then 'company' else destination_type end from flagged where not (dg and relationship = 'Has Applicant')""")
def ext_demote_applicants(spark, d):
    e, t = M.demoted_applicants(chunks(spark, d), firms(spark, d), links(spark, d))
    e = e.select(F.lit("entity").alias("what"), "project_id", "seq", "name", F.col("entity_type").alias("kind"), F.array_join("kinds", ",").alias("other"))
    return e.union(t.select(F.lit("triplet"), "project_id", "seq", F.concat("source_node", F.lit(" "), "destination_node"), "source_type", "destination_type"))


@query(f"""with chunks as ({_sql(CHUNKS)}), links as ({_sql(LINKS)}), made as (select *, case when relationship = 'manufactured-by' then {S.core("destination_node")} else '' end as core from links), {_spoken("made")}
select m.project_id, m.seq, source_node, relationship, destination_node from made m left join spoken s on s.project_id = m.project_id and s.core = m.core where s.core is null or s.manufacturer or regexp_matches(description, '{vocab.MANUFACTURER_CUES}')""")
def ext_drop_manufacturers(spark, d):
    return M.without_unspoken_manufacturers(chunks(spark, d), links(spark, d)).select("project_id", "seq", "source_node", "relationship", "destination_node")


#: Companies and applicants of the noisy triplets, some as plants and branches of others.
ORGS = """select project_id, kind, seq, case seq % 7 when 0 then concat(name, ' Plant') when 1 then concat('East ', name, ' Plant') when 2 then concat(name, ' Systems') else name end as name from (
  select project_id, lower(source_type) as kind, seq * 2 as seq, source_node as name from {raw} union all select project_id, lower(destination_type), seq * 2 + 1, destination_node from {raw}) where kind in ('company', 'applicant')"""
_words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
_generic = f"lambda w: w in ({S.quoted(vocab.GENERIC_ORG_WORDS)})"


def _fuller(x: str) -> str:
    return f"(({S.company(x)} <> '' and {S.entity(x)} <> {S.company(x)})::int, len(list_filter(string_split({S.company(x)}, ' '), {_generic})), length({x}))"


def _same(s: str, t: str) -> str:
    """One core is the other, or has only generic words behind it, of word lists."""
    return f"({t}[1:len({s})] = {s} and len(list_filter({t}[len({s}) + 1:], {_generic})) = len({t}) - len({s}) and not (len({s}) < len({t}) and len({s}) = 1 and {s}[1] in ({S.quoted(vocab.WEAK_COMPANY_WORDS)})))"


@query(f"""with recursive {S.RAW}, orgs as ({ORGS.replace("{raw}", "raw")}), x as materialized (select *, {_words(S.entity("name"))} as n, {_words(S.company("name"))} as c, {S.core("name")} <> {S.key("name")} as formal from (select project_id, kind, trim(name) as name, min(seq) as seq from orgs where trim(name) <> '' group by 1, 2, 3)),
alike as materialized (select a.project_id, a.kind, a.name as a, b.name as b from x a join x b on a.project_id = b.project_id and a.kind = b.kind and len(a.n) <= len(b.n) and len(a.n) > 0 where a.n = b.n or (len(a.c) > 0 and len(b.c) > 0 and ({_same("a.c", "b.c")} or {_same("b.c", "a.c")})) or (len(a.n) >= 2 and len(a.n) < len(b.n) and b.n[len(b.n) - len(a.n) + 1:] = a.n)),
two_ways as materialized (select * from alike union select project_id, kind, b, a from alike), reach as (select project_id, kind, a, b from two_ways union select r.project_id, r.kind, r.a, e.b from reach r join two_ways e on e.project_id = r.project_id and e.kind = r.kind and e.a = r.b),
put as (select x.*, coalesce(f.firm, x.name) as firm from x left join (select project_id, kind, a, min(b) as firm from reach group by 1, 2, 3) f on f.project_id = x.project_id and f.kind = x.kind and f.a = x.name),
pick as (select project_id, kind, firm, (list(name order by formal desc, length(name) desc, seq, name desc))[1] as p, (list(name order by length(name) desc, seq, name desc))[1] as q from put group by 1, 2, 3),
weighed as (select *, {_words(S.company("p"))} as pc, {_words(S.company("q"))} as qc from pick),
best as (select project_id, kind, firm, case when len(pc) > 0 and len(qc) > 0 and ({_same("pc", "qc")} or {_same("qc", "pc")}) then case when {_fuller("p")} >= {_fuller("q")} then p else q end when (len({_words(S.entity("p"))}), length(p)) >= (len({_words(S.entity("q"))}), length(q)) then p else q end as canonical from weighed)
select project_id, kind, name, canonical from put join best using (project_id, kind, firm)""")
def dedup_companies(spark, d):
    return firms_.company_variants(spark.sql(ORGS, raw=core.raw(spark, d)))
