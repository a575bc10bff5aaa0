"""Queries on de-duplication, repair and product targets."""

from pyspark.sql import functions as F

from kgloom.functions import vocab
from kgloom.operators import dedup as D
from kgloom.operators import extraction as X
from kgloom.operators import products as P
from kgloom.operators import variants as V
from kgloom.operators.components import written
from kgloom.plans import core, extraction
from kgloom.plans import sqltext as S
from kgloom.plans.core import query_into
from kgloom.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
query = query_into(QUERIES, ORACLE_SQL)

ENTITIES = "select project_id, place as seq, name, type from ({items})"


def entities(spark, d):
    items = spark.sql(extraction.ITEMS.replace("from raw", "from {raw}"), raw=core.raw(spark, d))
    return items.select("project_id", F.col("place").alias("seq"), "name", X.entity_type(F.col("type")).alias("entity_type"))


N_ = f"{S.RAW}, items as ({extraction.SQL_ITEMS}), ents as (select project_id, place as seq, name, {extraction._type('type')} as entity_type from items)"
PLAUSIBLE = S.plausible(S.clean_company("name"))


@query(f"""with {N_}, x as (select project_id, entity_type, seq, trim(name) as name, {S.key("name")} as key from ents where trim(name) <> '' and entity_type <> 'entity' and (entity_type not in ('company', 'applicant') or {PLAUSIBLE})),
f as (select *, row_number() over (partition by project_id, entity_type, key order by seq, name) as i from x) select project_id, entity_type, seq, name, case when entity_type in ('product', 'model') then entity_type || ':' || key else key end as identity_key from f where i = 1""")
def dedup_bucket(spark, d):
    return D.buckets(entities(spark, d))


def _folded(t: str, key: str) -> str:
    return f"""shaped as (select {key}, seq, description, {S.short("description")} as form from {t}), firsts as (select {key}, min(seq) as seq, count(*) filter (form <> '') as filled, arg_min(description, (seq, description)) as first_text, arg_min(form, (seq, description)) as first_form from shaped group by {key}),
shortest as (select {key}, form, row_number() over (partition by {key} order by length(form), seq desc, form) as i from shaped where form <> ''),
kws as (select {key}, trim(keywords) as k, min(seq) as first_at from {t} where trim(keywords) <> '' group by {key}, trim(keywords)), folds as (select {key}, list_reduce(list(k order by first_at, k), lambda a, x: case when contains(a, x) then a else a || ' | ' || x end) as keywords from kws group by {key}),
merged as (select {", ".join("f." + k.strip() for k in key.split(","))}, f.seq, case when filled = 1 and first_form <> '' then first_text else coalesce(s.form, '') end as description, coalesce(g.keywords, '') as keywords from firsts f left join (select * from shortest where i = 1) s using ({key}) left join folds g using ({key}))"""


@query(f"with {S.RAW}, {_folded('raw', 'project_id, source_node')} select * from merged")
def text_merge(spark, d):
    return D.merged_texts(core.raw(spark, d), ["project_id", "source_node"], "description", ["keywords"])


@query(f"""with {S.RAW}, keyed as (select *, lower(trim(source_type)) as st, lower(trim(destination_type)) as dt, {S.key("source_node")} as sk, {S.key("destination_node")} as dk, {S.key("relationship")} as rk from raw),
{_folded("keyed", "project_id, st, sk, rk, dt, dk")}, ends as (select project_id, st, sk, rk, dt, dk, source_node, destination_node, row_number() over (partition by project_id, st, sk, rk, dt, dk order by seq, source_node, destination_node) as i from keyed)
select m.*, source_node, destination_node from merged m join (select * from ends where i = 1) using (project_id, st, sk, rk, dt, dk)""")
def dedup_rels(spark, d):
    return D.relationships(core.raw(spark, d)).select("project_id", "st", "sk", "rk", "dt", "dk", "seq", "description", "keywords", "source_node", "destination_node")


#: Standards as cited by different bodies.
STANDARDS = "select distinct project_id, case length(source_node) % 4 when 0 then destination_node when 1 then replace(replace(destination_node, ' ', ''), 'IEC', 'UL/CSA ') when 2 then replace(replace(destination_node, ' ', ''), 'IEC', 'UL CSA/IEC ') else concat(destination_node, ' ') end as name from {raw} where destination_type = 'standard'"
_form = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '[\s_/|,;]+', ' ', 'g'), '[^\p{L}\p{N}_\s.\-]', '', 'g'), '\s+', ' ', 'g'))"
_num = r"[0-9]+[a-z0-9]*(?:[.\-][0-9]+[a-z0-9]*)*"
SAME_STANDARD = f"""{S.RAW}, std as ({STANDARDS.replace("{raw}", "raw")}), forms as (select project_id, name, {_form} as form from std),
cut as (select *, regexp_extract(form, '^(.*?)({_num})(.*)$', 2) as num, list_sort(list_distinct(list_filter(string_split(regexp_extract(form, '^(.*?)({_num})(.*)$', 1), ' '), lambda w: length(w) between 2 and 5 and regexp_full_match(w, '\\p{{L}}+')))) as bodies from forms),
pairs as (select distinct a.project_id, a.name as x, b.name as y from cut a join cut b on a.project_id = b.project_id and (a.form = b.form or (a.num <> '' and a.num = b.num and len(a.bodies) > 0 and len(b.bodies) > 0 and (a.bodies = b.bodies or (len(a.bodies) >= 2 and len(b.bodies) >= 2 and (list_has_all(a.bodies, b.bodies) or list_has_all(b.bodies, a.bodies))))))),
reach(project_id, x, y) as (select project_id, x, y from pairs union select r.project_id, r.x, p.y from reach r join pairs p on p.project_id = r.project_id and p.x = r.y),
canonical_of as (select project_id, x as name, arg_min(y, lpad(cast(1000 - length(y) as varchar), 4, '0') || y) as canonical from reach group by 1, 2)"""


def standard_names(spark, d):
    return spark.sql(STANDARDS, raw=core.raw(spark, d))


@query(f"with recursive {SAME_STANDARD} select * from canonical_of")
def dedup_standards(spark, d):
    return D.standards(standard_names(spark, d))


def _renamed(end: str) -> str:
    form = _form.replace("name", end)
    return f"""coalesce((select max(canonical) from changed c where c.project_id = t.project_id and c.name = trim(t.{end})), (select max(canonical) from changed c where c.project_id = t.project_id and {S.key("c.name")} = {S.key("t." + end)}), (select max(canonical) from changed c where c.project_id = t.project_id and {_form.replace("name", "c.name")} = {form.replace(end, "t." + end)}), t.{end}) as {end}"""


@query(f"with recursive {SAME_STANDARD}, changed as (select * from canonical_of where name <> canonical), t as (select distinct project_id, source_node, destination_node from raw where destination_type = 'standard'), u as (select {_renamed('destination_node')}, project_id, source_node from t) select project_id, source_node, destination_node, count(*) as n from u group by all")
def dedup_rename(spark, d):
    t = core.raw(spark, d).where("destination_type = 'standard'").select("project_id", "source_node", "destination_node").distinct()
    return D.renamed(t, written(D.standards(standard_names(spark, d)))).groupBy("project_id", "source_node", "destination_node").agg(F.count("*").alias("n"))


NAME_LISTS = "select p_partkey as id, concat(p_name, ' (', p_type, ', ', p_brand, ', 2025), ', p_brand, case p_partkey % 4 when 0 then concat(' and ', p_type) when 1 then concat(', ', upper(p_brand)) when 2 then concat(' (x, ', p_type) else ' , ,' end) as raw from {part}"
_edge = "' \"' || chr(39)"
_split = lambda p: f"list_filter(list_transform(regexp_split_to_array(x, '{p}'), lambda y: trim(y, {_edge})), lambda y: y <> '')"
_good = lambda e: f"(len({e}) > 1 and len(list_filter({e}, lambda y: length(y) < 2)) = 0)"
_and, _slash, _plus = _split(r"(?i)\s+and\s+"), _split(r"\s*/\s*"), _split(r"\s+\+\s+")


@query(rf"""with t as (select id, trim(regexp_replace(raw, '\s+', ' ', 'g')) as raw from ({NAME_LISTS.replace("{part}", "part")})), p as (select id, list_filter(list_transform(regexp_extract_all(raw, '((?:[^,(]|\([^()]*\)?)+)'), lambda y: trim(y, {_edge})), lambda y: y <> '') as ps from t),
e as (select id, i, ps[i] as x from (select id, ps, unnest(range(1, len(ps) + 1)) as i from p)), f as (select id, i, case when {_good(_and)} then {_and} when {_good(_slash)} then {_slash} when {_good(_plus)} then {_plus} else [x] end as xs from e),
g as (select id, i, j, xs[j] as x from (select id, i, xs, unnest(range(1, len(xs) + 1)) as j from f)), h as (select *, row_number() over (partition by id, {S.key("x")} order by i, j) as k from g) select id, string_agg(x, ';' order by i, j) as names from h where k = 1 group by id""")
def prod_parse_targets(spark, d):
    return adapters.fixture(spark, d, NAME_LISTS).select("id", F.array_join(D.target_names(F.col("raw")), ";").alias("names"))


@query(f"with {S.RAW}, x as (select seq, {S.relation('relationship')} as relationship, source_node, destination_node from raw) select *, count(*) as n from x group by all")
def rep_canon_rels(spark, d):
    return D.canonical_relations(core.raw(spark, d)).groupBy("seq", "relationship", "source_node", "destination_node").agg(F.count("*").alias("n"))


STAGED = "select project_id, document_id, seq, source_type, case when seq % 50 = 7 then concat(source_node, ' DVT2') else source_node end as source_node, case when seq % 400 = 3 then 'has-variant' else relationship end as relationship, destination_type, destination_node, description, keywords from {raw}"


@query(f"""with {S.RAW}, t as ({STAGED.replace("{raw}", "raw")}), k as (select *, {S.relation("relationship")} as rel, {S.key("source_node")} as sk, {S.key("destination_node")} as dk from t), gone as (select distinct project_id, dk as key from k where rel = 'has_variant')
select seq, source_node, destination_node, count(*) as n from k where rel <> 'has_variant' and not regexp_matches(source_node, '(?i)\\b(evt|dvt|pvt)[0-9]*\\b') and not regexp_matches(destination_node, '(?i)\\b(evt|dvt|pvt)[0-9]*\\b') and (project_id, sk) not in (select (project_id, key) from gone) and (project_id, dk) not in (select (project_id, key) from gone) group by all""")
def rep_drop_variants(spark, d):
    t = spark.sql(STAGED, raw=core.raw(spark, d))
    return D.without_stages(t).groupBy("seq", "source_node", "destination_node").agg(F.count("*").alias("n"))


FIRMS = "select * except (source_node), case when seq % 9 = 4 then 'Global' else source_node end as source_node from {raw}"


@query(f"with {S.RAW}, t as (select * exclude (source_node), case when seq % 9 = 4 then 'Global' else source_node end as source_node from raw) select seq, source_node, destination_node, count(*) as n from t where ({S.type_of('source_type')} not in ('company', 'applicant') or {PLAUSIBLE.replace('name', 'source_node')}) and ({S.type_of('destination_type')} not in ('company', 'applicant') or {PLAUSIBLE.replace('name', 'destination_node')}) group by all")
def rep_drop_orgs(spark, d):
    return D.without_implausible(spark.sql(FIRMS, raw=core.raw(spark, d))).groupBy("seq", "source_node", "destination_node").agg(F.count("*").alias("n"))


K = f"{S.RAW}, k as (select *, {S.type_of('source_type')} as st, {S.type_of('destination_type')} as dt, {S.relation('relationship')} as rel, {S.key('source_node')} as sk, {S.key('destination_node')} as dk from raw)"
_tok = lambda x: f"list_distinct(list_filter(string_split({S.entity(x)}, ' '), lambda w: w <> ''))"


@query(f"""with {K}, both_ends as (select project_id, st as kind, sk as key, source_node as name from k union select project_id, dt, dk, destination_node from k), named as (select project_id, kind, key, min(name) as name from both_ends group by 1, 2, 3),
p as (select project_id, name as product, {_tok("name")} as pw from named where kind = 'product'), m as (select project_id, name as model, {_tok("name")} as mw from named n where kind = 'model' and (project_id, key) not in (select (project_id, dk) from k where rel = 'has_model' and dt = 'model'))
select project_id, min(product) as product, model from m join p using (project_id) where list_has_all(mw, pw) and len(list_filter(pw, lambda w: length(w) >= 3)) > 0 group by project_id, model having count(distinct product) = 1""")
def rep_product_model(spark, d):
    return D.product_models(core.raw(spark, d))


#: Products of most projects have one model each, whatever the documents call it.
ONE_MODEL = "select project_id, document_id, seq, source_type, source_node, relationship, destination_type, case when source_type = 'product' and destination_type = 'model' and project_id < 'run_7' then concat(source_node, ' base') else destination_node end as destination_node, description, keywords from {raw}"


@query(f"""with {K.replace("from raw)", "from (" + ONE_MODEL.replace("{raw}", "raw") + ") few)")}, one as (select project_id, sk as product, min(dk) as model from (select distinct project_id, sk, dk from k where st = 'product' and rel = 'has_model' and dt = 'model') group by 1, 2 having count(*) = 1)
select distinct k.project_id, model, dk as component from k join one on one.project_id = k.project_id and one.product = k.sk where st = 'product' and rel = 'contains' and dt = 'component' and (k.project_id, model, dk) not in (select (project_id, sk, dk) from k where st = 'model' and rel = 'contains' and dt = 'component')""")
def rep_model_component(spark, d):
    return D.model_components(spark.sql(ONE_MODEL, raw=core.raw(spark, d)))


@query(f"""with recursive {K}, links as (select distinct project_id, sk as a, dk as b from k union select distinct project_id, dk, sk from k), start as (select 'run_' || (p_partkey % 10) as project_id, {S.key("p_brand")} as key from part where p_partkey < 6),
reach(project_id, key) as (select * from start where (project_id, key) in (select (project_id, a) from links) union select l.project_id, l.b from reach r join links l on l.project_id = r.project_id and l.a = r.key)
select seq, count(*) as n from k where (project_id, sk) in (select (project_id, key) from reach) or project_id not in (select project_id from start) group by seq""")
def rep_target_filter(spark, d):
    targets = adapters.read(spark, d, "part").where("p_partkey < 6").select(F.concat(F.lit("run_"), F.col("p_partkey") % 10).alias("project_id"), F.col("p_brand").alias("name"))
    return D.within_reach(core.raw(spark, d), targets).groupBy("seq").agg(F.count("*").alias("n"))


@query(f"with {N_}, own as (select distinct project_id, {S.key('name')} as key from ents where seq % 3 <> 0), t as (select * from raw) select seq, count(*) as n from t where (project_id, {S.key('source_node')}) in (select (project_id, key) from own) and (project_id, {S.key('destination_node')}) in (select (project_id, key) from own) group by seq")
def rep_cross_project(spark, d):
    return D.of_own_project(core.raw(spark, d), entities(spark, d).where("seq % 3 <> 0")).groupBy("seq").agg(F.count("*").alias("n"))


NAMED = "select * from {raw} union all select project_id, document_id, seq, 'product', destination_node, 'has_model', 'model', lower(destination_node), '', '' from {raw} where destination_type = 'product' and seq % 3 = 0"


@query(f"""with {S.RAW}, t as ({NAMED.replace("{raw}", "raw")}), k as (select *, {S.type_of("source_type")} as st, {S.type_of("destination_type")} as dt, {S.relation("relationship")} as rel, {S.key("source_node")} as sk, {S.key("destination_node")} as dk from t),
pair as (select distinct project_id, sk, dk from k where rel = 'has_model' and st = 'product' and dt = 'model'), gone as (select project_id, dk as key from pair p where sk = dk and exists (select 1 from pair q where q.project_id = p.project_id and q.sk = p.sk and q.dk <> q.sk))
select seq, source_node, destination_node, count(*) as n from k where not (st = 'model' and (project_id, sk) in (select (project_id, key) from gone)) and not (dt = 'model' and (project_id, dk) in (select (project_id, key) from gone)) group by all""")
def rep_drop_named_models(spark, d):
    return D.without_named_models(spark.sql(NAMED, raw=core.raw(spark, d))).groupBy("seq", "source_node", "destination_node").agg(F.count("*").alias("n"))


#: Models as documents write them, and components with part numbers in their names or evidence.
MODELS = """select concat('run_', cast(p_partkey % 10 as string)) as project_id, p_partkey as seq, case p_partkey % 8 when 0 then concat(p_brand, ' ', p_name) when 1 then concat(p_brand, '  ', upper(p_name), ' 2021') when 2 then concat(p_name, ' ', p_brand, ' Gen ', cast(p_size % 3 as string))
  when 3 then concat(p_brand, ' ', p_name, ' Pro') when 4 then concat(p_brand, ' ', p_name, ' ', cast(p_size as string), ' mm') when 5 then p_name when 6 then concat(p_brand, ' ', p_name, ' v', cast(p_size % 2 as string), ' 2022') else p_brand end as name from {part}"""
OWNERS = """select concat('run_', cast(p_partkey % 10 as string)) as project_id, 'product' as source_type, p_brand as source_node, 'has_model' as relationship, 'model' as destination_type, concat(p_brand, ' ', p_name, case when p_size % 2 = 0 then ' Pro' else '' end) as destination_node from {part} where p_size % 5 = 0"""
COMPONENTS = """select concat('run_', cast(p_partkey % 10 as string)) as project_id, p_partkey as seq, case p_partkey % 6 when 0 then concat('Battery ', p_name) when 1 then concat('battery  ', p_name, 's') when 2 then concat(p_type, ' pack BP-', cast(p_size as string)) when 3 then concat('BP-', cast(p_size as string), ' cell')
  when 4 then concat(p_name, ' fuses') else concat(p_name, ' Fuse') end as name, case when p_partkey % 4 = 0 then concat('Part AB', cast(p_size as string), '/', cast(p_partkey % 7 as string), ' of IEC-60950') when p_partkey % 5 = 0 then concat('see bp-', cast(p_size as string)) else '' end as evidence,
  case when p_partkey % 9 = 0 then 'spare' else '' end as component_description from {part}"""
_words = lambda k: f"list_sort(list_distinct(list_filter(string_split({k}, ' '), lambda w: w <> '')))"
_specs = {"year": r"\b20[0-9]{2}\b", "size": r"\b[0-9]+\s*(?:inch|in|cm|mm)\b", "generation": r"\b(?:gen(?:eration)?\s*[0-9]+|g[0-9]+)\b", "revision": r"\b(?:v[0-9]+|rev\s*[0-9]+|r[0-9]+)\b"}
_same = lambda k: f"list_has_all(a.{k}, b.{k}) and list_has_all(b.{k}, a.{k})"


@query(f"""with recursive m as (select project_id, seq, name, {S.key("name")} as key from ({adapters.as_sql(MODELS)})), parents as (select project_id, {S.key("destination_node")} as key, list(distinct {S.key("source_node")}) as owners from ({adapters.as_sql(OWNERS)}) group by 1, 2),
k as (select x.*, coalesce(owners, []) as owners from (select distinct project_id, key, {_words("key")} as ws, {", ".join(f"list_distinct(regexp_extract_all(key, '{p}')) as {c}" for c, p in _specs.items())}, list_filter({_words("key")}, lambda w: w in ('ultra', 'plus', 'pro', 'max', 'mini', 'lite', 'se', 'fe', 'edge', 'note')) as marks from m) x left join parents using (project_id, key)),
pairs as (select a.project_id, a.key as x, b.key as y from k a join k b on a.project_id = b.project_id and (a.key = b.key or (least(len(a.ws), len(b.ws)) >= 2 and (list_has_all(a.ws, b.ws) or list_has_all(b.ws, a.ws)) and {_same("marks")}
  and {" and ".join(f"(len(a.{c}) = 0 or len(b.{c}) = 0 or ({_same(c)}))" for c in _specs)} and (len(a.owners) = 0 or len(b.owners) = 0 or list_has_any(a.owners, b.owners))))),
reach(project_id, x, y) as (select project_id, x, y from pairs union select r.project_id, r.x, p.y from reach r join pairs p on p.project_id = r.project_id and p.x = r.y),
named as (select r.project_id, r.x, m.name, row_number() over (partition by r.project_id, r.x order by len({_words("m.key")}) desc, length(m.name) desc, m.seq, m.name) as i from reach r join m on m.project_id = r.project_id and m.key = r.y)
select distinct m.project_id, m.name, n.name as canonical from m join named n on n.project_id = m.project_id and n.x = m.key and n.i = 1""")
def dedup_models(spark, d):
    return V.model_variants(adapters.fixture(spark, d, MODELS), adapters.fixture(spark, d, OWNERS))


_parts = lambda t: f"list_distinct(list_filter(list_transform(regexp_extract_all({t}, '(?i)\\b[A-Z]{{1,8}}[0-9]*[A-Z0-9]*[-/][A-Z0-9]+(?:[-/][A-Z0-9]+)*\\b'), lambda x: upper(x)), lambda x: regexp_matches(x, '[0-9]') and lower(regexp_extract(x, '^[^0-9/-]*')) not in ('ul', 'iec', 'iso', 'ieee', 'csa', 'en', 'ansi', 'astm')))"
_singular = "case when length(w) < 4 or regexp_matches(w, '(ss|us|is|ics)$') then k when regexp_matches(w, 'ies$') and length(w) >= 5 then k[:-4] || 'y' when regexp_matches(w, '(ches|shes|xes|zes)$') then k[:-3] when regexp_matches(w, 's$') then k[:-2] else k end"


@query(f"""with recursive c as (select *, trim(name || case when evidence <> '' then ' ' || evidence else '' end || case when component_description <> '' then ' ' || component_description else '' end) as body from ({adapters.as_sql(COMPONENTS)})),
t as (select *, {_parts("body")} as parts, {S.key("body")} as k, regexp_extract({S.key("body")}, '[^ ]*$') as w from c), f as (select *, case when len(parts) > 0 then list_transform(parts, lambda p: 'p' || p) else ['k' || {_singular}] end as marks from t),
e as (select project_id, seq, unnest(marks) as mark from f), pairs as (select distinct a.project_id, a.mark as x, b.mark as y from e a join e b using (project_id, seq)),
reach(project_id, x, y) as (select * from pairs union select r.project_id, r.x, p.y from reach r join pairs p on p.project_id = r.project_id and p.x = r.y), class as (select project_id, x as mark, min(y) as class from reach group by 1, 2),
g as (select f.*, class from f join class on class.project_id = f.project_id and class.mark = f.marks[1]), tw as (select *, len(list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda w: lower(w) not in ('rev', 'revision'))) as n from g),
r as (select *, row_number() over (partition by project_id, class order by len({_parts("name || ' ' || evidence")}) > 0 and n > 0 and not regexp_matches(name, '(?i)^[A-Z]{{1,8}}[0-9]*[A-Z0-9]*[-/][A-Z0-9]*[0-9]') desc, n desc, length(name) desc, seq, name) as i from tw)
select g.project_id, g.seq, g.name, r.name as canonical from g join r on r.project_id = g.project_id and r.class = g.class and r.i = 1""")
def dedup_components(spark, d):
    return V.component_variants(adapters.fixture(spark, d, COMPONENTS))


#: Products with an alias and the file they are from, and what users ask for.
PRODUCTS = """select concat('run_', cast(p_partkey % 10 as string)) as project_id, p_partkey as seq, case p_partkey % 4 when 0 then concat(p_brand, ' ', p_name) when 1 then concat(p_name, ' ', cast(p_size as string)) when 2 then concat(upper(p_brand), ' ', p_name, ' pro') else p_brand end as name,
  case when p_partkey % 3 = 0 then concat(p_name, ' ', p_type) end as alias, concat(replace(p_name, ' ', '_'), '_', cast(p_size as string), '.v1.pdf') as source_file from {part}"""
TARGETS = """select concat('run_', cast(p_partkey % 10 as string)) as project_id, p_name as target from {part} union select concat('run_', cast(p_partkey % 10 as string)), lower(p_brand) from {part} union select concat('run_', cast(p_partkey % 10 as string)), concat(p_name, ' ', p_type, ' case') from {part}
union select concat('run_', cast(p_partkey % 10 as string)), concat('the ', p_type, ' ', p_name) from {part} union select concat('run_', cast(p_partkey % 10 as string)), concat(p_name, ' ', cast(p_size as string), ' v1') from {part}"""
_run = lambda x: f"trim(regexp_replace({S.key(x)}, ' +', ' ', 'g'))"


@query(f"""with p as (select * from ({adapters.as_sql(PRODUCTS)})), t as (select distinct * from ({adapters.as_sql(TARGETS)})), named as (select project_id, seq, name, 0 as pos, name as alias from p union all select project_id, seq, name, 1, alias from p where alias is not null),
al as (select project_id, alias, arg_max(name, seq) as product, min((seq, pos)) as place from named group by 1, 2), fo as (select project_id, {S.key("alias")} as form, arg_min(product, place) as product from al group by 1, 2),
x as (select t.project_id, t.target, coalesce(al.product, fo.product) as product from t left join al on al.project_id = t.project_id and al.alias = t.target left join fo on fo.project_id = t.project_id and fo.form = {S.key("t.target")}),
n as (select project_id, seq, name, {_run("n")} as k from (select project_id, seq, name, unnest([name, alias, replace(regexp_replace(source_file, '[.][^.]*$', ''), '_', ' ')]) as n from p) where n is not null),
met as (select distinct x.project_id, x.target, n.seq, n.name, {_run("x.target")} as tk from x join n on n.project_id = x.project_id and x.product is null and n.k <> '' and (contains(' ' || n.k || ' ', ' ' || {_run("x.target")} || ' ') or contains(' ' || {_run("x.target")} || ' ', ' ' || n.k || ' '))),
f as (select * from met qualify row_number() over (partition by project_id, target, {S.key("name")} order by seq, name) = 1),
b as (select * from f qualify row_number() over (partition by project_id, target order by abs(len(string_split({_run("name")}, ' ')) - len(string_split(tk, ' '))), length(name), seq, name) = 1)
select x.project_id, x.target, coalesce(x.product, b.name) as product from x left join b using (project_id, target)""")
def prod_resolve_target(spark, d):
    p = adapters.fixture(spark, d, PRODUCTS).withColumn("aliases", F.array_compact(F.array("alias")))
    return P.resolved_targets(p, adapters.fixture(spark, d, TARGETS))
