"""Queries on names, triplets and the graph, with the SQL they are held against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators import canonical, chunks, graph
from kgloom.operators import triplets as T
from kgloom.operators.components import written
from kgloom.plans import sqltext as S
from kgloom.sources import adapters
from kgloom.sources.adapters import fixture

QUERIES, ORACLE_SQL = {}, {}


def query_into(queries: dict, oracles: dict):
    """A decorator that registers a query under its name, with its SQL if there is one."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return query


query = query_into(QUERIES, ORACLE_SQL)


def raw(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, adapters.TRIPLETS)


def canon(spark: SparkSession, d: str) -> DataFrame:
    """As a table: the name rules are long expressions, and what follows reads them more than once."""
    return written(T.canonicalize(raw(spark, d)))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, adapters.NAME_PAIRS)


def node_edge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = canon(spark, d)
    return written(canonical.nodes(c)), written(canonical.edges(c))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return written(canonical.edges(canon(spark, d)))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, adapters.PAGES_SPARK)


PAIRS = f"pairs as ({adapters.as_sql(adapters.NAME_PAIRS)})"
P = f"pages as ({adapters.PAGES_SQL})"


# names
@query(f"with {PAIRS} select id, {S.entity('right_name')} as norm, {S.slug('right_name')} as slug, {S.key('right_name')} as norm_key from pairs")
def norm_entity(spark, d):
    c = F.col("right_name")
    return pairs(spark, d).select("id", N.norm_entity(c).alias("norm"), N.slug(c).alias("slug"), N.norm_key(c).alias("norm_key"))


@query(f"with {PAIRS} select id, {S.company('right_name')} as norm from pairs")
def norm_company(spark, d):
    return pairs(spark, d).select("id", N.norm_company(F.col("right_name")).alias("norm"))


@query(f"with {S.RAW} select seq, {S.standard('destination_node')} as norm, case when regexp_extract(destination_node, '([0-9]+(?:[.][0-9]+)+|[0-9]+)', 1) = '' then {S.entity('destination_node')} else regexp_extract(destination_node, '([0-9]+(?:[.][0-9]+)+|[0-9]+)', 1) end as number from raw")
def norm_standard(spark, d):
    c = F.col("destination_node")
    return raw(spark, d).select("seq", N.norm_standard(c).alias("norm"), N.clause_number(c).alias("number"))


@query(f"""with {S.RAW}, x as (select seq, destination_node, relationship, {S.graph_type('destination_type')} as k from raw)
select seq, {S.for_type('k', 'destination_node')} as norm, case k when 'ul' then 'UL' else upper(k[1]) || k[2:] end as label, upper(regexp_replace(trim(relationship), '[^a-zA-Z0-9_]', '_', 'g')) as relation from x""")  # fmt: skip
def norm_for_type(spark, d):
    k = F.col("destination_type")
    return raw(spark, d).select("seq", N.norm_for_type(k, F.col("destination_node")).alias("norm"), N.label(k).alias("label"), N.relation_type(F.col("relationship")).alias("relation"))


EQUIVALENT = f"""{PAIRS}, forms as (select *, list_filter(string_split({S.company('left_name')}, ' '), lambda w: w <> '') as a, list_filter(string_split({S.company('right_name')}, ' '), lambda w: w <> '') as b,
  list_filter(string_split({S.entity('left_name')}, ' '), lambda w: w <> '') as x, list_filter(string_split({S.entity('right_name')}, ' '), lambda w: w <> '') as y from pairs),
sides as (select *, case when len(a) <= len(b) then a else b end as cs, case when len(a) <= len(b) then b else a end as cl, case when len(x) <= len(y) then x else y end as es, case when len(x) <= len(y) then y else x end as el from forms),
judged as (select *, len(a) > 0 and len(b) > 0 and (a = b or (cl[1:len(cs)] = cs and len(cl) > len(cs) and len(list_filter(cl[len(cs) + 1:], lambda w: w not in ({S.quoted(vocab.GENERIC_ORG_WORDS)}))) = 0
    and not (len(cs) = 1 and cs[1] in ({S.quoted(vocab.WEAK_COMPANY_WORDS)})))) as firms from sides)"""


@query(f"with {EQUIVALENT} select id, len(x) > 0 and len(y) > 0 and (x = y or firms or (len(es) >= 2 and len(es) < len(el) and el[len(el) - len(es) + 1:] = es)) as same from judged")
def name_equivalent(spark, d):
    return pairs(spark, d).select("id", N.names_equivalent(F.col("left_name"), F.col("right_name")).alias("same"))


@query(f"""with {EQUIVALENT}, ranked as (select *, trim(left_name) as l, trim(right_name) as r from judged), g as (select *,
  case when {S.company('l')} <> '' and {S.entity('l')} <> {S.company('l')} then 1 else 0 end as lf, case when {S.company('r')} <> '' and {S.entity('r')} <> {S.company('r')} then 1 else 0 end as rf,
  len(list_filter(a, lambda w: w in ({S.quoted(vocab.GENERIC_ORG_WORDS)}))) as lg, len(list_filter(b, lambda w: w in ({S.quoted(vocab.GENERIC_ORG_WORDS)}))) as rg from ranked)
select id, case when l = '' then r when r = '' then l when firms then case when (lf, lg, length(l)) >= (rf, rg, length(r)) then l else r end when (len(x), length(l)) >= (len(y), length(r)) then l else r end as name from g""")  # fmt: skip
def name_preferred(spark, d):
    return pairs(spark, d).select("id", N.preferred(F.col("left_name"), F.col("right_name")).alias("name"))


@query(f"with {S.ENDS} select distinct entity_type, name, canonical_id from ends")
def canonical_id(spark, d):
    return canonical.ends(canon(spark, d)).select("entity_type", "name", "canonical_id").distinct()


@query(f"with {S.RAW} select seq, {S.short('description')} as description from raw")
def text_desc_norm(spark, d):
    return raw(spark, d).select("seq", N.short_description(F.col("description")).alias("description"))


# triplets
@query(f"with {S.JUDGED} select * exclude (document_id) from judged")
def tri_canonicalize(spark, d):
    return T.judge(raw(spark, d)).drop("document_id")


@query(f"with {S.JUDGED} select seq, verdict from judged where verdict in ('empty name', 'serves', 'not allowed')")
def tri_rejects(spark, d):
    return T.rejected(raw(spark, d)).select("seq", "verdict")


FILLED = "coalesce(arg_min(description, seq) filter (description <> ''), '') as description, coalesce(arg_min(keywords, seq) filter (keywords <> ''), '') as keywords, min(seq) as seq"


@query(f"with {S.CANON} select project_id, source_type, source_node, relationship, destination_type, destination_node, arg_min(document_id, seq) as document_id, {FILLED} from canon group by 1, 2, 3, 4, 5, 6")
def tri_dedupe(spark, d):
    return T.dedupe(canon(spark, d))


@query(f"with {S.RAW} select project_id, seq, lower(trim(source_type)) as source_type, trim(source_node) as source_node, trim(relationship) as relationship, lower(trim(destination_type)) as destination_type, trim(destination_node) as destination_node, {S.short('description')} as description, keywords from raw where trim(source_node) <> '' and trim(destination_node) <> ''")
def tri_from_rels(spark, d):
    return T.from_relationships(raw(spark, d)).drop("document_id")


@query(f"with {S.RAW}, {S.RULES} select seq from raw join rules on rs = {S.type_of('source_type')} and rr = {S.relation('relationship')} and rd = {S.type_of('destination_type')}")
def tri_allowed(spark, d):
    return T.allowed(raw(spark, d)).select("seq")


TYPED = f"{S.RAW}, t as (select *, {S.type_of('source_type')} as st, {S.type_of('destination_type')} as dt, {S.relation('relationship')} as rel, {S.key('source_node')} as sk, {S.key('destination_node')} as dk from raw)"
GENERIC = f"({S.company('name')} in ({S.quoted([*vocab.GENERIC_ORG_WORDS, *vocab.WEAK_COMPANY_WORDS])}))"
APPLICANTS = f"""{TYPED}, seen as (select project_id, seq, 0 as e, trim(source_node) as name from t where st = 'applicant' or (rel = 'has_product' and st in ('applicant', 'company'))
  union all select project_id, seq, 1, trim(destination_node) from t where dt = 'applicant' or rel = 'party_role_applicant'),
applicants as (select project_id, {S.key('name')} as key, arg_min(name, seq * 2 + e) as name, min(seq) as seq from seen where name <> '' and not {S.root('name')} and not {GENERIC} group by 1, 2)"""


@query(f"with {APPLICANTS} select * from applicants")
def tri_applicants(spark, d):
    return T.applicants(raw(spark, d))


@query(f"with {APPLICANTS} select project_id, name as destination_node from applicants a where not exists (select 1 from t where t.rel = 'party_role_applicant' and ({S.root('t.source_node')} or t.st = 'ul') and t.project_id = a.project_id and t.dk = a.key)")
def tri_ul_links(spark, d):
    return T.root_links(raw(spark, d)).select("project_id", "destination_node")


@query(f"""with {TYPED}, std as (select project_id, sk, dk as std, arg_min(trim(destination_node), seq) as std_name, min(seq) as std_seq from t where rel = 'complies_with' and st = 'component' and dt = 'standard' group by 1, 2, 3),
cert as (select project_id, sk, dk as cert, arg_min(trim(destination_node), seq) as cert_name, min(seq) as cert_seq from t where rel = 'has_certification' and st = 'component' and dt = 'certification' group by 1, 2, 3),
linked as (select project_id, std, cert, std_name, cert_name, row_number() over (partition by project_id, std, cert order by cert_seq, std_seq) as n from std join cert using (project_id, sk))
select project_id, std_name as source_node, cert_name as destination_node from linked l where n = 1 and not exists (select 1 from t where rel = 'has_certification' and st = 'standard' and dt = 'certification' and t.project_id = l.project_id and t.sk = std and t.dk = cert)""")  # fmt: skip
def tri_std_cert(spark, d):
    return T.link_certifications(raw(spark, d)).select("project_id", "source_node", "destination_node")


@query(f"""with {TYPED}, owned as (select distinct project_id, sk as product, dk as model from t where rel = 'has_model' and st = 'product' and dt = 'model'),
named as (select project_id, model, arg_max(name, o) as shown from (select project_id, sk as model, trim(source_node) as name, seq * 2 as o from t where st = 'model' union all select project_id, dk, trim(destination_node), seq * 2 + 1 from t where dt = 'model') group by 1, 2),
counted as (select project_id, product, count(*) as n, min(shown) as shown from owned left join named using (project_id, model) group by 1, 2),
has as (select distinct project_id, sk as model, dk from t where rel = 'contains' and st = 'model'),
edge as (select t.*, c.n, c.shown, m.model is not null as is_model from t left join counted c on c.project_id = t.project_id and c.product = t.sk left join named m on m.project_id = t.project_id and m.model = t.sk where rel = 'contains' and st = 'product'
  and not exists (select 1 from owned o join has h using (project_id, model) where o.project_id = t.project_id and o.product = t.sk and h.dk = t.dk))
select seq, source_type, source_node, relationship, destination_node from t where not (rel = 'contains' and st = 'product') union all
select seq, 'model', case when n = 1 then shown else source_node end, 'contains', destination_node from edge where n = 1 or (n is null and is_model)""")  # fmt: skip
def tri_refine_ownership(spark, d):
    return T.refine_ownership(raw(spark, d)).select("seq", "source_type", "source_node", "relationship", "destination_node")


@query(f"""with {APPLICANTS}, owner as (select distinct t.project_id, t.dk as product, t.sk as app, a.name as app_name from t join applicants a on a.project_id = t.project_id and a.key = t.sk where rel = 'has_product' and st in ('applicant', 'company') and dt = 'product'),
parent as (select distinct project_id, sk as product, dk as component from t where rel = 'contains' and st = 'product' and dt = 'component' union
  select distinct m.project_id, m.sk, c.dk from t m join t c on c.project_id = m.project_id and c.sk = m.dk where m.rel = 'has_model' and m.st = 'product' and m.dt = 'model' and c.rel = 'contains' and c.st = 'model' and c.dt = 'component'),
of_component as (select distinct project_id, component, app, app_name from parent join owner using (project_id, product)),
e as (select project_id, seq, rel = 'party_role_manufacturer' as made, trim(source_node) as s, trim(destination_node) as d, sk, dk, keywords, case when {S.root('source_node')} then 'ul' else st end as st, case when {S.root('destination_node')} then 'ul' else dt end as dt from t where rel in ('party_role_supplier', 'party_role_manufacturer')),
parts as (select project_id, seq, made, case when st = 'component' then d else s end as supplier, case when st = 'component' then sk else dk end as component from e where (st = 'component' and dt = 'company') or (dt = 'component' and st = 'company')),
rows_ as (select p.project_id, seq, made, supplier, app, app_name from parts p join of_component using (project_id, component) union all
  select p.project_id, p.seq, made, supplier, a.key, a.name from parts p join applicants a on a.project_id = p.project_id where not made and not exists (select 1 from of_component o where o.project_id = p.project_id and o.component = p.component))
select project_id, supplier_key, app, arg_min(supplier, case when made then 1 else 0 end * 1000000000000 + seq) as supplier from (select *, {S.key('supplier')} as supplier_key from rows_) where supplier_key <> app group by 1, 2, 3""")  # fmt: skip
def tri_supplier_rewrite(spark, d):
    x = T.suppliers(raw(spark, d))
    return x.select("project_id", N.norm_key(F.col("source_node")).alias("supplier_key"), N.norm_key(F.col("destination_node")).alias("app"), F.col("source_node").alias("supplier"))


@query()
def tri_enforce(spark, d):
    return T.enforce(raw(spark, d))


@query(f"with {TYPED} select project_id, st as entity_type, count(distinct sk) as n from (select project_id, st, sk from t union all select project_id, dt, dk from t) group by 1, 2")
def tri_entity_count(spark, d):
    x = T._typed(raw(spark, d))
    both = x.select("project_id", F.col("st").alias("entity_type"), F.col("sk").alias("k")).union(x.select("project_id", "dt", "dk"))
    return both.groupBy("project_id", "entity_type").agg(F.countDistinct("k").alias("n"))


@query(f"""with {TYPED}, x as (select project_id, sk as k, {S.short('description')} as description from t union all select project_id, dk, {S.short('description')} from t)
select project_id, k, min(lpad(cast(length(description) as varchar), 6, '0') || description)[7:] as description from x where description <> '' group by 1, 2""")  # fmt: skip
def tri_desc_map(spark, d):
    x = T._typed(raw(spark, d)).withColumn("description", N.short_description(F.col("description")))
    both = x.select("project_id", F.explode(F.array("sk", "dk")).alias("k"), "description").where("description <> ''")
    return both.groupBy("project_id", "k").agg(F.min(F.struct(F.length("description").alias("n"), F.col("description").alias("d")))["d"].alias("description"))


# the canonical graph
@query(f"with {S.NODES} select entity_type, canonical_id, name, normalized_name, coalesce(array_to_string(aliases, ';'), '') as aliases, description, mentions from nodes")
def kg_merge_nodes(spark, d):
    return canonical.nodes(canon(spark, d)).withColumn("aliases", F.array_join("aliases", ";"))


@query(f"with {S.EDGES} select * exclude (document_ids), array_to_string(document_ids, ';') as document_ids from edges")
def kg_merge_edges(spark, d):
    return canonical.edges(canon(spark, d)).withColumn("document_ids", F.array_join("document_ids", ";"))


@query(f"with {S.NODES} select entity_type, canonical_id, description from nodes where description <> ''")
def kg_node_desc(spark, d):
    return canonical.nodes(canon(spark, d)).where("description <> ''").select("entity_type", "canonical_id", "description")


HINTS = f"""{S.CANON}, g as (select {S.graph_type('source_type')} as s, {S.graph_type('destination_type')} as t, relationship as rel, source_node, destination_node from canon),
hints as (select distinct t as entity_type, destination_node as name, source_node as parent from g where (rel = 'has_clause' and s = 'standard' and t = 'clause') or (rel = 'has_product' and s = 'company' and t = 'product') or (rel = 'has_model' and s = 'product' and t = 'model'))"""


@query(f"with {HINTS} select * from hints")
def kg_parent_hints(spark, d):
    return canonical.parent_hints(canon(spark, d))


@query(f"with {HINTS}, m as (select s as entity_type, source_node as name from g union select t, destination_node from g) select entity_type, name, coalesce(parent, '') as parent, cast({S.case({k: i for i, k in enumerate(vocab.CANONICAL_TYPES)}, 'entity_type', '17')} as int) as type_rank from m left join hints using (entity_type, name)")
def kg_mentions(spark, d):
    return canonical.mentions(canon(spark, d))


@query(f"""with {S.EDGES}, owner as (select source_id as owner, destination_id as product from edges where relationship = 'HAS_PRODUCT'), held as (
  select owner, e.destination_id as component from owner join edges e on e.relationship = 'CONTAINS' and e.source_id = product union
  select owner, e.destination_id from owner join edges m on m.relationship = 'HAS_MODEL' and m.source_id = product join edges e on e.relationship = 'CONTAINS' and e.source_id = m.destination_id)
select distinct m.destination_id as source_id, owner as destination_id from edges m join held on m.relationship = 'PARTY_ROLE_MANUFACTURER' and m.source_id = component where owner <> m.destination_id
  and not exists (select 1 from edges k where k.relationship = 'PARTY_ROLE_SUPPLIER' and k.source_id = m.destination_id and k.destination_id = owner)""")  # fmt: skip
def kg_link_suppliers(spark, d):
    return canonical.link_suppliers(edges_of(spark, d))


@query(f"""with {S.EDGES} select distinct a.destination_id as source_id, b.destination_id from edges a join edges b on a.source_id = b.source_id where a.relationship = 'COMPLIES_WITH' and a.source_type = 'component' and b.relationship = 'HAS_CERTIFICATION' and b.source_type = 'component'
  and not exists (select 1 from edges k where k.relationship = 'HAS_CERTIFICATION' and k.source_type = 'standard' and k.source_id = a.destination_id and k.destination_id = b.destination_id)""")  # fmt: skip
def kg_link_std_cert(spark, d):
    return canonical.link_certifications(edges_of(spark, d))


@query(f"with {S.CANON} select seq, 'ev_' || sha256(document_id || '|relationship|' || {S.canonical_id(S.graph_type('source_type'), 'source_node')} || '|||' || upper(relationship))[1:24] as evidence_id from canon")
def kg_evidence_id(spark, d):
    return canonical.evidence_ids(canon(spark, d))


@query()
def kg_absorb(spark, d):
    n, e = node_edge(spark, d)
    return canonical.absorb(e, canonical.company_clusters(n)).withColumn("document_ids", F.array_join("document_ids", ";"))


@query("select arg_min(doc_id, doc_id) as document_id, count(*) as copies, sha256(text) as content_hash from documents group by text")
def kg_merge_documents(spark, d):
    x = adapters.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return x.groupBy("content_hash").agg(F.min("doc_id").alias("document_id"), F.count("*").alias("copies"))


# graph queries
PLAN_ROWS = " union all ".join(f"select '{p}' as path, '{r}' as root, {i} as k" for i, (p, (r, _)) in enumerate([*vocab.LINEAGE_PATHS.items(), ("nowhere", ("product", ()))]))
PLANS = f"""select b.n * 100 + k.k as plan_id, case k.root when 'ul' then 'UL' when 'company' then concat('Supplier#00000000', cast(b.n % 10 as string)) when 'standard' then concat('IEC ', cast(60000 + b.n as string)) else case when b.n = 7 then ' ' else b.p_brand end end as entity_name,
  case when b.n % 9 = 8 then 'model' else k.root end as entity_label, k.path, case when b.n % 4 = 1 then '1' else '' end as terminal_contains, case when b.n % 6 = 5 then 501 else 40 end as most
from (select p_brand, row_number() over (order by p_brand) as n from (select distinct p_brand from {{part}}) q) b cross join ({PLAN_ROWS}) k"""
VALID = f"""plans as ({PLANS.replace("{part}", "part")}), checked as (select *, case when path not in ({S.quoted(vocab.LINEAGE_PATHS)}) then 'unknown path' when entity_label not in ('product', 'company', 'standard', 'ul') then 'unknown label'
  when entity_label <> {S.case({p: r for p, (r, _) in vocab.LINEAGE_PATHS.items()}, 'path', "''")} then 'wrong label' when trim(entity_name) = '' then 'no name' when most not between 1 and 500 then 'bad limit' else '' end as problem from plans)"""


@query(f"with {VALID} select plan_id, problem from checked")
def q_plan_validate(spark, d):
    return graph.valid_plans(fixture(spark, d, PLANS)).select("plan_id", "problem")


def _path_sql() -> str:
    out = []
    for path, (_, hops) in vocab.LINEAGE_PATHS.items():
        last, ids, joins = "r.id", "r.id", ""
        for i, (rel, ahead) in enumerate(hops):
            a, b = ("source_id", "destination_id") if ahead else ("destination_id", "source_id")
            joins += f" join edges e{i} on e{i}.relationship = '{rel}' and e{i}.{a} = {last}"
            last = f"e{i}.{b}"
            ids += f" || ' > ' || {last}"
        out.append(f"select distinct r.plan_id, r.path, r.most, r.terminal_contains, r.rank, {ids} as ids, {last} as last from roots r{joins} where r.path = '{path}'")
    return " union all ".join(out)


@query(f"""with {S.EDGES}, {VALID}, roots as (select c.*, n.canonical_id as id, case when lower(n.name) = lower(trim(entity_name)) then 0 else 1 end as rank from checked c join nodes n on n.entity_type = c.entity_label and contains(lower(n.name), lower(trim(entity_name))) where problem = ''),
walks as ({_path_sql()}), filtered as (select distinct plan_id, path, most, rank, ids from walks w where trim(terminal_contains) = '' or exists (select 1 from nodes n where n.canonical_id = w.last and contains(lower(n.name), lower(trim(terminal_contains))))),
ranked as (select *, row_number() over (partition by plan_id order by rank, ids) as n, min(rank) over (partition by plan_id) as best from filtered) select plan_id, path, ids from ranked where rank = best and n <= most""")  # fmt: skip
def q_lineage_paths(spark, d):
    return graph.lineage_paths(fixture(spark, d, PLANS), *node_edge(spark, d))


@query(f"with {S.EDGES} select entity_type as kind, count(*) as n from nodes group by 1 union all select relationship, count(*) from edges group by 1")
def q_counts(spark, d):
    n, e = node_edge(spark, d)
    return n.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).union(e.groupBy("relationship").agg(F.count("*")))


@query(f"with {S.EDGES} select distinct canonical_id, d as document_id from (select source_id as canonical_id, unnest(document_ids) as d from edges union all select destination_id, unnest(document_ids) from edges)")
def q_entity_documents(spark, d):
    e = edges_of(spark, d)
    return e.select(F.explode(F.array("source_id", "destination_id")).alias("canonical_id"), "document_ids").select("canonical_id", F.explode("document_ids").alias("document_id")).distinct()


@query(f"with {S.NODES}, q as (select distinct lower(p_brand) as query from part) select query, entity_type, canonical_id, n from (select query, entity_type, canonical_id, cast(row_number() over (partition by query order by name, canonical_id) as int) as n from nodes join q on contains(lower(name), query) or contains(normalized_name, query) or len(list_filter(aliases, lambda a: contains(lower(a), query))) > 0) where n <= 8")
def q_search_name(spark, d):
    texts = adapters.read(spark, d, "part").select(F.lower("p_brand").alias("query")).distinct()
    return graph.search_names(canonical.nodes(canon(spark, d)), texts)


# graph statistics
@query(f"with {S.BOTH}, k as (select b.id, n.entity_type as kind, count(*) as c from both_ways b join (select distinct canonical_id, entity_type from nodes) n on n.canonical_id = b.other group by 1, 2) select n.entity_type, n.canonical_id as id, cast(coalesce(sum(c), 0) as bigint) as degree, coalesce(string_agg(kind || '=' || c, ',' order by kind || '=' || c), '') as by_type from nodes n left join k on k.id = n.canonical_id group by 1, 2")
def g_degree(spark, d):
    return graph.degrees(*node_edge(spark, d))


@query(f"with {S.BOTH} select id, count(*) as degree from both_ways group by 1 order by degree desc, id limit 20")
def g_top_degree(spark, d):
    return graph.top_degree(*node_edge(spark, d))


@query(f"with {S.EDGES} select source_id, relationship, destination_id, cast(row_number() over (partition by least(source_id, destination_id), greatest(source_id, destination_id) order by source_id, relationship, destination_id) as int) as place, count(*) over (partition by least(source_id, destination_id), greatest(source_id, destination_id)) as pair_count from edges")
def g_parallel(spark, d):
    return graph.parallel(edges_of(spark, d))


@query(f"with {S.EDGES} select source_type, destination_type, count(*) as n from edges where {S.case(vocab.TIERS, 'source_type', '6')} <= 7 and {S.case(vocab.TIERS, 'destination_type', '6')} <= 7 group by 1, 2")
def g_type_pairs(spark, d):
    return graph.type_pairs(*node_edge(spark, d), 7)


@query(f"with {S.BOTH} select entity_type, canonical_id, cast({S.case(vocab.TIERS, 'entity_type', '6')} as int) as tier, {S.case(vocab.TIERS, 'entity_type', '6')} <= 2 or canonical_id not in (select id from both_ways) as seed from nodes")
def g_tiers(spark, d):
    return graph.tiers(*node_edge(spark, d))


@query(f"with {S.BOTH} select id, entity_type as kind, count(*) as n, string_agg(other, ',' order by other) as others from both_ways join (select distinct canonical_id, entity_type from nodes) on canonical_id = other group by 1, 2")
def g_neighbors_by_type(spark, d):
    return graph.neighbours_by_type(*node_edge(spark, d))


@query(f"""with recursive {S.BOTH}, roots as (select canonical_id as id from nodes where entity_type = 'standard'), walk(id, hop) as (select id, 0 from roots union select b.other, w.hop + 1 from walk w join both_ways b on b.id = w.id where w.hop < 3)
select id, cast(min(hop) as int) as hop from walk group by 1""")  # fmt: skip
def g_hops(spark, d):
    n, e = node_edge(spark, d)
    return graph.hops(e, n.where("entity_type = 'standard'").select(F.col("canonical_id").alias("id")), 3)


LINE = "relationship in ('HAS_PRODUCT', 'HAS_MODEL', 'CONTAINS', 'COMPLIES_WITH')"


@query(f"""with recursive {S.EDGES}, e as (select distinct source_id, destination_id from edges where {LINE} and source_id <> destination_id), walk(id, depth) as (select id, 0 from (select source_id as id from e union select destination_id from e) union select e.destination_id, w.depth + 1 from walk w join e on e.source_id = w.id)
select id, cast(max(depth) as int) as depth from walk group by 1""")  # fmt: skip
def g_depth(spark, d):
    return graph.depths(edges_of(spark, d).where(LINE))


# pages and chunks
@query(f"with {P} select document_id, page_number, trim(text) as text from pages where trim(text) <> ''")
def src_page_filter(spark, d):
    return chunks.filter_pages(pages(spark, d)).select("document_id", "page_number", "text")


def _packed(most: int) -> str:
    """A recursion over the pages of each document, with the running size of the open pack."""
    return f"""{P}, p as (select *, length(trim(text)) as n, row_number() over (partition by document_id order by page_number) as i from pages where trim(text) <> ''),
packs(document_id, i, pack, held) as (select document_id, 1, 0, n from p where i = 1 union all select p.document_id, p.i, case when k.held + p.n > {most} then k.pack + 1 else k.pack end, case when k.held + p.n > {most} then p.n else k.held + p.n end from packs k join p on p.document_id = k.document_id and p.i = k.i + 1)"""


@query(f"with recursive {_packed(2000)} select p.document_id, p.page_number, cast(k.pack as int) as pack from packs k join p using (document_id, i)")
def chunk_batches(spark, d):
    return chunks.pack_pages(chunks.filter_pages(pages(spark, d)), 2000)


@query(f"with recursive {_packed(1000)} select p.document_id, printf('chunk_%06d', k.pack + 1) as chunk_id, min(page_number) as first_page, max(page_number) as last_page, sha256(string_agg(trim(text), chr(10) || chr(10) order by page_number)) as text_hash from packs k join p using (document_id, i) group by p.document_id, k.pack")
def chunk_pack(spark, d):
    x = chunks.chunks(pages(spark, d), 1000)
    return x.select("document_id", "chunk_id", "first_page", "last_page", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))


def whole(spark, d):
    return adapters.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("chunk_000001").alias("chunk_id"), F.col("source").alias("project_id"), "text")


@query("select doc_id as document_id, 'chunk_000001' as chunk_id, source || ':chunk_000001' as index_id from documents where trim(text) <> ''")
def chunk_index_ids(spark, d):
    return chunks.index_ids(whole(spark, d))


QUESTIONS = "select turn + conv_id * 1000 as query_id, lower(text) as query from {conversations} where role = 'user' and conv_id % 50 = 0"


@query(rf"""with q as ({QUESTIONS.replace("{conversations}", "conversations")}), w as (select query_id, list_filter(list_distinct(string_split(trim(regexp_replace(query, '\s+', ' ', 'g')), ' ')), lambda x: x <> '') as ws from q), t as (select query_id, len(ws) as size, unnest(ws) as word from w),
c as (select doc_id, unnest(list_distinct(string_split(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), ' '))) as word from documents), g as (select query_id, doc_id, round(count(*) / any_value(size), 6) as score from t join c using (word) group by 1, 2),
r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as place from g) select query_id, doc_id as document_id, 'chunk_000001' as chunk_id, score, place from r where place <= 5""")  # fmt: skip
def chunk_search(spark, d):
    return chunks.search(fixture(spark, d, QUESTIONS), whole(spark, d))
