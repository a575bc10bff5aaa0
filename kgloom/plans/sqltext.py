"""SQL of the name rules and of the graph fixture, written apart from the column expressions, for the oracles."""

from kgloom.functions import vocab
from kgloom.sources import adapters


def quoted(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def case(table: dict, x: str, other: str | None = None) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then {repr(v)}" for k, v in table.items()) + f" else {other or x} end"


def key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '[\s_\-]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"


def entity(x: str) -> str:
    return rf"regexp_replace({key(x)}, '\s+', ' ', 'g')"


def slug(x: str) -> str:
    return f"trim(regexp_replace({entity(x)}, '[^a-z0-9]+', '_', 'g'), '_')"


def root(x: str) -> str:
    return f"({key(x)} in ({quoted(vocab.UL_NAMES)}) or starts_with({key(x)}, 'ul llc'))"


def company(x: str) -> str:
    out = f"trim({x})"
    for _ in range(3):
        out = rf"regexp_replace(regexp_replace({out}, '(?i)[\s,]+(?:{'|'.join(vocab.LEGAL_SUFFIXES)})\.?$', ''), '[ ,.]+$', '')"
    return f"case when trim({x}) = '' then '' when {root(x)} then 'ul solutions' else {entity(out)} end"


def clean_company(x: str) -> str:
    clean = rf"trim(regexp_replace(regexp_replace(trim({x}), '{vocab.RIGHTS}', ''), '\s+', ' ', 'g'), ' ,.;:|-')"
    return rf"trim(regexp_replace({clean}, '(?i)\s+and$', ''), ' ,.;:')"


def plausible(clean: str) -> str:
    """Of a clean name."""
    weak = quoted([*vocab.GENERIC_ORG_WORDS, *vocab.WEAK_COMPANY_WORDS])
    numbered = r"(?i)^(ul|iec|iso|csa|en|ieee|ansi|un|astm)\s*[0-9]"
    none = "all this these the our its their documentation privacy terms support introduction contents copyright india united international institute standard safety"
    return f"(length({clean}) >= 2 and not {root(clean)} and not regexp_matches({clean}, '{numbered}') and {company(clean)} not in ('ul', 'ul solutions') and {company(clean)} not in ({weak}) and not list_contains(string_split('{none}', ' '), lower({clean})))"


def core(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({key(x)}, '\s+', ' ', 'g')), '(?:(?:^| )(?:{'|'.join(vocab.CORE_SUFFIXES)}))+$', '')"


def standard(x: str) -> str:
    return entity(rf"regexp_replace(trim({x}), '(?i)\b([a-z]{{2,4}})[\s\-]*(\d)', '\1 \2', 'g')")


def for_type(kind: str, x: str) -> str:
    return f"case {kind} when 'company' then {company(x)} when 'standard' then {standard(x)} else {entity(x)} end"


def graph_type(x: str) -> str:
    return case(vocab.GRAPH_TYPE_ALIASES, f"replace(replace(lower(trim({x})), '-', '_'), ' ', '_')")


def type_of(x: str) -> str:
    return case(vocab.TYPE_ALIASES, f"lower(trim({x}))")


def relation(x: str) -> str:
    return case(vocab.RELATION_ALIASES, f"replace(replace(lower(trim({x})), ' ', '_'), '-', '_')")


def short(x: str) -> str:
    raw = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return rf"case when regexp_extract({raw}, '^(.*?[.!?])(?:\s|$)', 1) = '' then {raw} else regexp_extract({raw}, '^(.*?[.!?])(?:\s|$)', 1) end"


def canonical_id(kind: str, x: str) -> str:
    return f"case when {root(x)} then case when {kind} = 'ul' then 'ul_solutions' else {kind} || '_ul_solutions' end else {kind} || '_' || case when {slug(for_type(kind, x))} = '' then 'unknown' else {slug(for_type(kind, x))} end end"


RAW = f"raw as ({adapters.as_sql(adapters.TRIPLETS)})"

_rules = ", ".join(f"('{s}', '{r}', '{d}')" for s, r, d in vocab.RULES)
RULES = f"rules(rs, rr, rd) as (values {_rules})"

#: raw -> judged: canonical form and verdict
JUDGED = f"""{RAW}, {RULES},
names as (select *, trim(source_node) as s, trim(destination_node) as d, {relation("relationship")} as rel from raw),
typed as (select *, case when {root("s")} then 'ul' else {type_of("source_type")} end as st, case when {root("d")} then 'ul' else {type_of("destination_type")} end as dt from names),
looked as (select t.*, a.rr as ahead, b.rr as back, c.rr is not null as ok, f.rr is not null as flip, t.rel in (select rr from rules) as known from typed t
  left join rules a on a.rs = t.st and a.rd = t.dt left join rules b on b.rs = t.dt and b.rd = t.st
  left join rules c on c.rs = t.st and c.rr = t.rel and c.rd = t.dt left join rules f on f.rs = t.dt and f.rr = t.rel and f.rd = t.st),
verdicts as (select *, case when s = '' or d = '' then 'empty name' when rel = 'serves' then 'serves' when ok then 'kept' when flip then 'flipped'
  when not known and ahead is not null then 'defaulted' when not known and back is not null then 'defaulted back' else 'not allowed' end as verdict from looked),
judged as (select project_id, document_id, seq, case when verdict in ('flipped', 'defaulted back') then dt else st end as source_type, case when verdict in ('flipped', 'defaulted back') then d else s end as source_node,
  case verdict when 'defaulted' then ahead when 'defaulted back' then back else rel end as relationship,
  case when verdict in ('flipped', 'defaulted back') then st else dt end as destination_type, case when verdict in ('flipped', 'defaulted back') then s else d end as destination_node,
  {short("description")} as description, trim(keywords) as keywords, verdict from verdicts)"""

CANON = f"{JUDGED}, canon as (select * exclude (verdict) from judged where verdict in ('kept', 'flipped', 'defaulted', 'defaulted back'))"

ENDS = f"""{CANON}, ends as (select document_id, seq, description, e, entity_type, name, {canonical_id("entity_type", "name")} as canonical_id from (
  select document_id, seq, description, 0 as e, {graph_type("source_type")} as entity_type, source_node as name from canon union all
  select document_id, seq, description, 1, {graph_type("destination_type")}, destination_node from canon))"""

NODES = f"""{ENDS}, nodes as (select entity_type, canonical_id, name, {for_type("entity_type", "name")} as normalized_name, aliases, coalesce(description, '') as description, mentions from (
  select n.entity_type, n.canonical_id, n.name, n.description, n.mentions, list_sort(list(a.name) filter (a.name is not null)) as aliases
  from (select entity_type, canonical_id, arg_min(name, seq * 2 + e) as name, arg_min(description, lpad(cast(length(description) as varchar), 9, '0') || description) filter (description <> '') as description, count(*) as mentions from ends group by all) n
  left join (select distinct entity_type, canonical_id, name from ends) a on a.entity_type = n.entity_type and a.canonical_id = n.canonical_id and a.name <> n.name group by all))"""

EDGES = f"""{NODES}, edges as (select source_type, source_id, relationship, destination_type, destination_id, coalesce(arg_min(description, seq) filter (description <> ''), '') as description,
  coalesce(arg_min(keywords, seq) filter (keywords <> ''), '') as keywords, list_sort(list(distinct document_id)) as document_ids, count(*) as evidence_count from (
    select {graph_type("source_type")} as source_type, {canonical_id(graph_type("source_type"), "source_node")} as source_id, upper(relationship) as relationship, {graph_type("destination_type")} as destination_type,
      {canonical_id(graph_type("destination_type"), "destination_node")} as destination_id, description, keywords, document_id, seq from canon) group by source_type, source_id, relationship, destination_type, destination_id)"""

BOTH = f"{EDGES}, both_ways as (select distinct * from (select source_id as id, destination_id as other from edges union all select destination_id, source_id from edges) where id <> other)"
