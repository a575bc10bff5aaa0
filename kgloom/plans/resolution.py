"""Queries on resolution, ingest, collapse and questions."""

from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators import canonical, graph
from kgloom.operators import questions as Q
from kgloom.operators import resolution as R
from kgloom.operators import triplets as T
from kgloom.operators.components import written
from kgloom.plans import core
from kgloom.plans import sqltext as S
from kgloom.plans.core import EQUIVALENT, query_into
from kgloom.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
query = query_into(QUERIES, ORACLE_SQL)

#: Documents of even number are stored, the others are new.
STORED = "cast(substring(document_id, 5) as int) % 2 = 0"
HALF = f"{S.RAW.replace('raw as', 'raw0 as')}, raw as (select * from raw0 where {STORED})"
OLD = S.NODES.replace(S.RAW, HALF)
_new = S.ENDS.replace(S.RAW, "").lstrip(", ")
for _a in ("judged", "names", "typed", "looked", "verdicts", "canon", "ends"):
    _new = _new.replace(f"{_a} as (", f"new_{_a} as (").replace(f"from {_a} ", f"from new_{_a} ").replace(f"from {_a})", f"from new_{_a})")
_new = _new.replace(S.RULES + ",", "").replace("from raw)", f"from raw0 where not ({STORED}))")
MENTIONS = f"{OLD}, {_new}, mentions as (select distinct entity_type, name from new_ends)"


def halves(spark, d):
    raw = core.raw(spark, d)
    old, new = written(T.canonicalize(raw.where(STORED))), written(T.canonicalize(raw.where(f"not ({STORED})")))
    return old, new, written(canonical.nodes(old)), canonical.ends(new).select("entity_type", "name").distinct()


_words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
FORMS = f"""{MENTIONS}, m as (select entity_type, name, {S.canonical_id("entity_type", "name")} as id, {S.for_type("entity_type", "name")} as norm, {S.entity("name")} as form, {_words(S.company("name"))} as a, {_words(S.entity("name"))} as x from mentions),
n as (select entity_type, canonical_id, name as node_name, normalized_name as node_norm, list_transform(list_append(aliases, name), lambda v: {S.entity("v")}) as forms, {_words(S.company("name"))} as b, {_words(S.entity("name"))} as y from nodes),
met as (select m.*, n.* exclude (entity_type), case when len(a) <= len(b) then a else b end as cs, case when len(a) <= len(b) then b else a end as cl, case when len(x) <= len(y) then x else y end as es, case when len(x) <= len(y) then y else x end as el from m join n on m.entity_type = n.entity_type),
firm as (select *, len(a) > 0 and len(b) > 0 and (a = b or (cl[1:len(cs)] = cs and len(cl) > len(cs) and len(list_filter(cl[len(cs) + 1:], lambda w: w not in ({S.quoted(vocab.GENERIC_ORG_WORDS)}))) = 0 and not (len(cs) = 1 and cs[1] in ({S.quoted(vocab.WEAK_COMPANY_WORDS)})))) as firms from met),
cand as (select *, len(x) > 0 and len(y) > 0 and (x = y or firms or (len(es) >= 2 and len(es) < len(el) and el[len(el) - len(es) + 1:] = es)) as same from firm where id = canonical_id or (norm <> '' and norm = node_norm) or (form <> '' and list_contains(forms, form)) or (entity_type = 'company' and firms)),
scored as (select entity_type, name, canonical_id, node_name, case when id = canonical_id then 1.0 when entity_type in ('standard', 'certification') and norm = node_norm then 0.99 when norm <> '' and norm = node_norm then 0.95 when list_contains(forms, form) then 0.93 when same then 0.94 else 0.0 end::double as score from cand)"""


@query(f"with {FORMS} select entity_type, name, canonical_id from scored")
def kg_candidates(spark, d):
    _, _, nodes, mentions = halves(spark, d)
    return R.candidates(mentions, nodes)


@query(f"with {FORMS} select entity_type, name, canonical_id, score from scored")
def kg_score(spark, d):
    _, _, nodes, mentions = halves(spark, d)
    return R.scores(mentions, nodes).drop("node_name")


RESOLVED = f"{FORMS}, best as (select *, row_number() over (partition by entity_type, name order by score desc, canonical_id) as i from scored), resolved as (select m.entity_type, m.name, coalesce(b.canonical_id, m.id) as canonical_id, m.id as proposed, case when b.name is null and m.entity_type <> 'ul' then 'CREATED_NEW' else 'MATCHED_EXISTING' end as decision, coalesce(score, 1.0) as confidence from m left join (select * from best where i = 1 and score >= 0.9) b on b.entity_type = m.entity_type and b.name = m.name)"


@query(f"with {RESOLVED} select * exclude (proposed) from resolved")
def kg_resolve(spark, d):
    _, _, nodes, mentions = halves(spark, d)
    return R.resolve(mentions, nodes).drop("shown")


_id = lambda k, n: S.canonical_id(S.graph_type(k), n)
EDGE_ROWS = lambda t: f"select {S.graph_type('source_type')} as st, {_id('source_type', 'source_node')} as s, upper(relationship) as r, {S.graph_type('destination_type')} as dt, {_id('destination_type', 'destination_node')} as e, document_id from {t}"


@query(f"""with {RESOLVED}, moves as (select proposed, min(canonical_id) as keep from resolved where decision = 'MATCHED_EXISTING' and proposed <> canonical_id group by 1), old_rows as ({EDGE_ROWS("canon")}), new_rows as ({EDGE_ROWS("new_canon")}),
rows_ as (select st, s, r, dt, e, document_id from old_rows union all select st, coalesce(a.keep, s), r, dt, coalesce(b.keep, e), document_id from new_rows left join moves a on a.proposed = s left join moves b on b.proposed = e where coalesce(a.keep, s) <> coalesce(b.keep, e))
select s as source_id, r as relationship, e as destination_id, count(*) as evidence_count, count(distinct document_id) as documents from rows_ group by st, s, r, dt, e""")
def kg_ingest(spark, d):
    old, new, nodes, _ = halves(spark, d)
    docs = lambda t: written(t.select("document_id", F.sha2("document_id", 256).alias("content_hash")).distinct())
    known, fresh = docs(old), docs(new)
    n, e, k = (written(x) for x in R.ingest(new, fresh, nodes.select("entity_type", "canonical_id", "name", "normalized_name", "aliases"), written(canonical.edges(old)), known))
    # once more: all is known by now
    n2 = n.withColumn("normalized_name", N.norm_for_type(F.col("entity_type"), F.col("name")))
    again = R.ingest(new, fresh, n2, e, k)[1]
    return again.select("source_id", "relationship", "destination_id", "evidence_count", F.size("document_ids").cast("long").alias("documents"))


#: Models under ids of their own in each project.
CHILD = "md5(concat(project_id, destination_node))"


@query(f"""with {S.CANON}, c as (select distinct {CHILD} as id, destination_node as name, {S.entity("destination_node")} as norm, {S.canonical_id("'product'", "source_node")} as parent from canon where relationship = 'has_model'), p as (select id, max(parent) as parent from c group by 1), x as (select distinct c.id, name, norm, p.parent from c join p using (id)),
best as (select *, first_value(id) over (partition by parent, norm order by length(name) desc, id) as keep_id from x) select id as drop_id, keep_id from best where id <> keep_id""")
def kg_collapse_by_parent(spark, d):
    t = core.canon(spark, d).where("relationship = 'has_model'").select(F.expr(CHILD).alias("canonical_id"), F.col("destination_node").alias("name"), N.canonical_id(F.lit("product"), F.col("source_node")).alias("parent_id"))
    children = t.select("canonical_id", "name", N.norm_for_type(F.lit("model"), F.col("name")).alias("normalized_name")).distinct()
    return R.same_under_parent(children, t.select("canonical_id", "parent_id").distinct())


#: Models of brands under names that are variants of each other, and what they contain.
TWINS = """select concat('product_', lower(replace(p_brand, '#', ''))) as parent, concat('model_', cast(p_partkey as string)) as id, case p_partkey % 6 when 0 then p_name when 1 then concat(upper(p_name), ' systems') when 2 then concat(p_type, ' ', p_name) when 3 then concat(p_name, ' Group Ltd.') when 4 then p_type else concat(p_name, ' ', cast(p_size as string)) end as name,
  concat('component_', lower(p_type)) as part from {part}"""


def twins(spark, d):
    t = adapters.fixture(spark, d, TWINS)
    nodes = t.select(F.lit("model").alias("entity_type"), F.col("id").alias("canonical_id"), "name", F.array().cast("array<string>").alias("aliases"))
    nodes = nodes.union(t.select(F.lit("product"), "parent", F.col("parent").alias("name"), F.array().cast("array<string>")).distinct())
    edge = lambda a, r, b: t.select(F.col(a).alias("source_id"), F.lit(r).alias("relationship"), F.col(b).alias("destination_id"))
    return nodes, edge("parent", "HAS_MODEL", "id").union(edge("id", "CONTAINS", "part"))


@query(f"""with recursive t as ({adapters.as_sql(TWINS)}), {core.EQUIVALENT.replace(core.PAIRS, "pairs as (select a.id as x_id, b.id as y_id, a.name as left_name, b.name as right_name from t a join t b on a.parent = b.parent)").replace("*, list_filter", "*, list_filter", 1)},
same as (select distinct x_id, y_id from judged where len(x) > 0 and len(y) > 0 and (x = y or firms or (len(es) >= 2 and len(es) < len(el) and el[len(el) - len(es) + 1:] = es))),
reach(x_id, y_id) as (select x_id, y_id from same union select r.x_id, s.y_id from reach r join same s on s.x_id = r.y_id), keep as (select x_id as id, arg_min(t.id, (-length(t.name), t.id)) as keep_id from reach join t on t.id = y_id group by 1),
m as (select t.*, coalesce(keep_id, t.id) as kept from t left join keep using (id))
select 'node' as kind, kept as a, any_value(k.name) as b, coalesce(array_to_string(list_sort(list_distinct(list(m.name) filter (m.name <> k.name))), ';'), '') as c from m join (select id, name from t) k on k.id = kept group by 2 union all select distinct 'node', parent, parent, '' from t
union all select distinct 'edge', parent, 'HAS_MODEL', kept from m union all select distinct 'edge', kept, 'CONTAINS', part from m""")
def kg_collapse_under_parent(spark, d):
    n, e = R.collapse_under_parent(*twins(spark, d), "model", "HAS_MODEL")
    return n.select(F.lit("node").alias("kind"), F.col("canonical_id").alias("a"), F.col("name").alias("b"), F.array_join("aliases", ";").alias("c")).union(e.select(F.lit("edge"), "source_id", "relationship", "destination_id"))


SITES = "select case when n_nationkey % 2 = 0 then 'location' else 'manufacturing_location' end as entity_type, case when n_nationkey % 3 = 0 then lower(r_name) when n_nationkey % 3 = 1 then r_name else n_name end as name, n_nationkey as k from {nation} join {region} on n_regionkey = r_regionkey"
SITE_ID = "concat(entity_type, '_', lower(replace(name, ' ', '_')))"


@query(f"""with s as (select *, {SITE_ID} as id from ({adapters.as_sql(SITES)})), e as (select distinct 'company_' || s_suppkey as source_id, case when s.k % 2 = 0 then 'HAS_LOCATION' else 'HAS_MANUFACTURING_LOCATION' end as r, 'location_' || lower(replace(name, ' ', '_')) as destination_id from supplier join s on k = s_nationkey)
select distinct source_id, 'HAS_LOCATION' as relationship, destination_id from e""")
def kg_fold_locations(spark, d):
    s = adapters.fixture(spark, d, SITES).withColumn("id", F.expr(SITE_ID))
    nodes = s.select("entity_type", F.col("id").alias("canonical_id"), "name").distinct()
    e = adapters.read(spark, d, "supplier").join(s, F.col("k") == F.col("s_nationkey")).select(F.concat(F.lit("company_"), "s_suppkey").alias("source_id"), F.when(F.col("k") % 2 == 0, "HAS_LOCATION").otherwise("HAS_MANUFACTURING_LOCATION").alias("relationship"), F.col("id").alias("destination_id"))
    return R.fold_locations(nodes, e)[1]


LEGACY = f"{S.EDGES}, owned as (select canonical_id, case when length(canonical_id) % 7 = 3 then 'run_3' else 'ul_global' end as graph_id from nodes), gone as (select canonical_id from owned where graph_id = 'run_3')"


@query(f"with {LEGACY} select source_id, relationship, destination_id from edges where source_id not in (select canonical_id from gone) and destination_id not in (select canonical_id from gone)")
def kg_delete(spark, d):
    n, e = core.node_edge(spark, d)
    owned = n.select("canonical_id", F.when(F.length("canonical_id") % 7 == 3, "run_3").otherwise("ul_global").alias("graph_id"))
    return R.without_graph(owned, e, "run_3")[1].select("source_id", "relationship", "destination_id")


@query(f"""with recursive {EQUIVALENT.replace("judged as", "variants as").replace(core.PAIRS, S.NODES + ", pairs as (select row_number() over () as id, a.canonical_id as ia, b.canonical_id as ib, a.name as left_name, b.name as right_name from nodes a join nodes b on a.entity_type = 'company' and b.entity_type = 'company' and a.canonical_id <> b.canonical_id)")},
same as (select ia, ib from variants where len(x) > 0 and len(y) > 0 and (x = y or firms or (len(es) >= 2 and len(es) < len(el) and el[len(el) - len(es) + 1:] = es))), reach(a, b) as (select ia, ib from same union select r.a, s.ib from reach r join same s on s.ia = r.b),
grp as (select canonical_id as id, coalesce((select min(b) from reach where a = canonical_id), canonical_id) as other, name from nodes where entity_type = 'company'), g as (select id, least(id, other) as root, name from grp),
best as (select root, arg_max(id, (case when {S.entity("name")} <> {S.company("name")} then '1' else '0' end) || lpad(cast(length(name) as varchar), 6, '0') || id) as keep_id from g group by 1) select id as drop_id, keep_id from g join best using (root) where id <> keep_id""")
def kg_collapse_companies(spark, d):
    return canonical.company_clusters(written(canonical.nodes(core.canon(spark, d))))


#: Edges with what must go: supplier edges on components, ends that don't exist, one edge twice.
WORSE = "select source_type, source_id, relationship, destination_type, destination_id from {edges} union all select 'company', destination_id, 'PARTY_ROLE_SUPPLIER', 'component', source_id from {edges} where relationship = 'PARTY_ROLE_MANUFACTURER' union all select source_type, source_id, relationship, destination_type, concat(destination_id, '_gone') from {edges} where length(source_id) % 5 = 0 union all select source_type, source_id, relationship, destination_type, destination_id from {edges} where length(destination_id) % 4 = 0"


def worse(spark, d):
    n, e = core.node_edge(spark, d)
    return n, spark.sql(WORSE, edges=e)


@query(f"with {S.EDGES}, worse as ({WORSE.replace('{edges}', 'edges')}) select source_id, relationship, destination_id, count(*) as n from worse where not (relationship = 'PARTY_ROLE_SUPPLIER' and (source_type = 'component' or destination_type = 'component')) group by all")
def kg_drop_disallowed(spark, d):
    return canonical.drop_disallowed(worse(spark, d)[1]).groupBy("source_id", "relationship", "destination_id").agg(F.count("*").alias("n"))


@query(f"with {S.EDGES}, worse as ({WORSE.replace('{edges}', 'edges')}) select distinct source_id, relationship, destination_id from worse where source_id in (select canonical_id from nodes) and destination_id in (select canonical_id from nodes)")
def g_clean_edges(spark, d):
    return graph.clean_edges(*worse(spark, d)).select("source_id", "relationship", "destination_id")


# questions
ASKED = "select turn + conv_id * 1000 as query_id, concat(case conv_id % 5 when 0 then 'Which models and components does ' when 1 then 'Show the standards, clauses of ' when 2 then 'Is the certificate required for ' when 3 then 'Who? ' else 'suppliers ' end, '\"Brand#1', cast(conv_id % 5 as string), '\" ', text) as query from {conversations} where role = 'user'"
SQL_ASKED = ASKED.replace("{conversations}", "conversations").replace("as string", "as varchar")


def asked(spark, d):
    return adapters.fixture(spark, d, ASKED)


_tokens = "list_transform(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda t: trim(lower(t), './-_'))"
_intents = "list_filter([" + ", ".join(f"case when list_has_any({_tokens}, [{S.quoted(v)}]) then '{k}' end" for k, v in vocab.INTENT_TERMS.items()) + "], lambda k: k is not null)"
_relations = "list_concat(" + ", ".join(f"case when list_contains(intents, '{k}') then [{S.quoted(vocab.TRAIL_TARGETS[k][1])}] else [] end" for k in vocab.INTENT_TERMS) + ")"
_labels = "list_concat(" + ", ".join(f"case when list_contains(intents, '{k}') then [{S.quoted(vocab.INTENT_LABELS[k])}] else [] end" for k in vocab.INTENT_TERMS) + ")"


@query(f"with q as ({SQL_ASKED}), i as (select query_id, {_intents} as intents from q), l as (select query_id, intents, {_labels} as all_labels from i) select query_id, array_to_string(intents, ',') as intents, array_to_string(list_filter(all_labels, lambda x, i: list_position(all_labels, x) = i), ',') as labels, array_to_string(list_filter(rels, lambda x, i: list_position(rels, x) = i), ',') as relations from (select *, {_relations} as rels from l)")
def q_intent_targets(spark, d):
    return Q.targets(asked(spark, d)).select("query_id", F.array_join("intents", ",").alias("intents"), F.array_join("labels", ",").alias("labels"), F.array_join("relations", ",").alias("relations"))


_once = lambda a: f"list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"
# the words of each intent, and those that are no keywords, as questions must be understood; apart from the operator's own tables
_understood = {
    "company": "company companies manufacturer supplier brand", "product": "product products device devices", "model": "model models variant variants", "component": "component components part parts assembly",
    "standard": "standard standards regulation regulations", "clause": "clause clauses section sections requirement", "certification": "certification certifications certificate certified", "test": "test tests testing evaluation",
    "relationships": "relationship relationships associated connected contain contains produces applies between", "compliance": "compliance compliant requirement requirements required applicable",
}
_skipped = "a about all an and are as associated at be between by can contain contains do does for from has have how in information is it me of on present show that the this to what when where which why with"
_understood_sql = "list_filter([" + ", ".join(f"case when list_has_any({_tokens}, string_split('{v}', ' ')) then '{k}' end" for k, v in _understood.items()) + "], lambda k: k is not null)"


@query(rf"""with q as ({SQL_ASKED}), n as (select query_id, {_understood_sql} as intents, list_filter(list_transform(list_concat(regexp_extract_all(query, '["'']([^"'']{{2,120}})["'']', 1), list_filter(regexp_extract_all(query, '\b([A-Z][A-Za-z0-9._/-]*(?:\s+[A-Z0-9][A-Za-z0-9._/-]*)*)', 1), lambda x: lower(x) not in ('what', 'which', 'show', 'why', 'how'))), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as n,
  list_filter(regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9._/-]*'), lambda t: length(trim(t, './-_')) >= 2 and not list_contains(string_split('{" ".join(_understood.values())} {_skipped}', ' '), trim(lower(t), './-_')) and not regexp_full_match(trim(t, './-_'), '[0-9]+')) as p from q),
m as (select *, ({_once("n")})[1:8] as names from n), k as (select *, list_concat(names, p) as c from m)
select query_id, case when len(intents) = 0 then 'general_document_information' else array_to_string(intents, ',') end as intents, array_to_string(names, ';') as names, array_to_string(({_once("c")})[1:16], ';') as keywords from k""")
def q_understand(spark, d):
    return Q.understood(asked(spark, d)).select("query_id", F.array_join("intents", ",").alias("intents"), F.array_join("names", ";").alias("names"), F.array_join("keywords", ";").alias("keywords"))


NAMES_ASKED = "select p_size as query_id, case p_size % 3 when 0 then p_brand when 1 then upper(p_brand) else p_type end as name from (select distinct p_size, p_brand, p_type from {part})"


@query(f"""with {S.NODES}, q as (select distinct query_id, lower(trim(name)) as t from ({NAMES_ASKED.replace("{part}", "part")})), h as (select query_id, canonical_id, case when lower(name) = t then 0 when entity_type in ('product', 'model', 'company') then 1 else 2 end as rank, -length(t) as n from nodes join q on contains(lower(name), t)),
b as (select query_id, canonical_id, min((rank, n)) as s from h group by 1, 2), r as (select query_id, canonical_id, s[1] as rank, cast(row_number() over (partition by query_id order by s[1], s[2], canonical_id) as int) as place from b) select query_id, canonical_id, cast(rank as int) as rank, place from r where place <= 10""")
def q_seeds(spark, d):
    return Q.seeds(adapters.fixture(spark, d, NAMES_ASKED), canonical.nodes(core.canon(spark, d)))


_paths = core.ORACLE_SQL["q_lineage_paths"]
_head, _tail = _paths.rsplit(" select plan_id, path, ids from ranked", 1)


@query(f"{_head}, paths as (select plan_id, string_split(ids, ' > ') as p from ranked{_tail}), steps as (select plan_id, p[i] as a, p[i + 1] as b from (select plan_id, p, unnest(range(1, len(p))) as i from paths)) select distinct plan_id, a, b from steps")
def q_path_evidence(spark, d):
    return Q.path_evidence(core.q_lineage_paths(spark, d))[1]


#: Links of the root to the applicants.
LINKED = "select * from {raw} union all select project_id, document_id, seq, 'ul', 'UL LLC', 'has_applicant', 'applicant', source_node, '', '' from {raw} where source_type = 'applicant'"


@query(f"with {S.EDGES.replace(S.RAW, S.RAW.replace('raw as', 'raw0 as') + ', raw as (' + LINKED.replace('{raw}', 'raw0') + ')')} select n.name as company, n.canonical_id, relationship from edges e join nodes n on n.canonical_id = e.destination_id and n.entity_type = 'company' where e.source_id = 'ul_solutions'")
def q_ul_companies(spark, d):
    t = written(T.canonicalize(spark.sql(LINKED, raw=core.raw(spark, d))))
    n, e = canonical.nodes(t), canonical.edges(t)
    return e.where("source_id = 'ul_solutions'").join(n.where("entity_type = 'company'"), F.col("destination_id") == F.col("canonical_id")).select(F.col("name").alias("company"), "canonical_id", "relationship")


@query(f"""with {S.EDGES}, n as (select 'node' as kind, canonical_id as a, entity_type as r, '' as b from nodes order by entity_type, name, canonical_id limit 2000), e as (select 'edge' as kind, source_id as a, relationship as r, destination_id as b from edges order by source_id, relationship, destination_id limit 4000)
select * from n union all select * from e union all select 'nodes', cast(count(*) as varchar), '', '' from nodes union all select 'edges', cast(count(*) as varchar), '', '' from edges""")
def q_graph_export(spark, d):
    n, e = core.node_edge(spark, d)
    total = lambda x, k: x.select(F.lit(k).alias("kind"), F.lit(1).alias("one")).groupBy("kind").agg(F.count("*").cast("string").alias("a")).select("kind", "a", F.lit("").alias("r"), F.lit("").alias("b"))
    top = n.orderBy("entity_type", "name", "canonical_id").limit(2000).select(F.lit("node").alias("kind"), F.col("canonical_id").alias("a"), F.col("entity_type").alias("r"), F.lit("").alias("b"))
    some = e.orderBy("source_id", "relationship", "destination_id").limit(4000).select(F.lit("edge").alias("kind"), F.col("source_id").alias("a"), F.col("relationship").alias("r"), F.col("destination_id").alias("b"))
    return top.union(some).union(total(n, "nodes")).union(total(e, "edges"))


@query()
def g_fuzzy_search(spark, d):
    texts = adapters.read(spark, d, "part").select(F.lower("p_brand").alias("query")).distinct()
    return Q.fuzzy_search(canonical.nodes(core.canon(spark, d)), texts)


@query(f"with {S.NODES}, n as (select lower(name) as low, min(canonical_id) as canonical_id from nodes group by 1), e as (select p_size as query_id, concat(p_brand, case when p_size % 2 = 0 then ' ' else '' end) as name from (select distinct p_size, p_brand from part) union all select distinct p_size, p_type || ' ' || p_size || ' nowhere' from part) select query_id, name, n.canonical_id, n.canonical_id is not null as found from e left join n on n.low = lower(trim(name))")
def g_evidence_join(spark, d):
    p = adapters.read(spark, d, "part")
    e = p.select("p_size", "p_brand").distinct().select(F.col("p_size").alias("query_id"), F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, " ").otherwise("")).alias("name"))
    e = e.union(p.select("p_size", F.concat("p_type", F.lit(" "), "p_size", F.lit(" nowhere"))).distinct())
    return Q.evidence_found(e, canonical.nodes(core.canon(spark, d)))


@query("select source as graph_id, count(*) as documents, max(doc_id) as newest, string_agg(distinct lower(source || case when doc_id % 2 = 0 then '.pdf' else '.PDF' end), ',') as files from documents group by 1")
def q_list_graphs(spark, d):
    docs = adapters.read(spark, d, "documents").withColumn("file", F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".PDF")))
    files = F.array_join(F.array_sort(F.collect_set(F.lower("file"))), ",")
    return docs.groupBy(F.col("source").alias("graph_id")).agg(F.count("*").alias("documents"), F.max("doc_id").alias("newest"), files.alias("files")).orderBy(F.desc("newest"))
