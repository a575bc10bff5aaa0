"""Graph fixtures from the given tables, as SQL that Spark and other engines read alike."""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "part", "supplier", "nation", "region", "customer", "documents", "conversations", "embeddings", "events", "orders")

#: One noisy triplet for each line item: aliases of relations, swapped ends, unknown and disallowed relations.
TRIPLETS = """
select concat('run_', cast(b.ok % 10 as string)) as project_id, concat('doc_', cast(b.ok % 100 as string)) as document_id, b.seq,
  case when b.swap = 1 then b.dt else b.st end as source_type, case when b.swap = 1 then b.dn else b.sn end as source_node, b.rel as relationship,
  case when b.swap = 1 then b.st else b.dt end as destination_type, case when b.swap = 1 then b.sn else b.dn end as destination_node,
  case when b.ok % 4 = 0 then '' else concat(b.sn, ' ', b.rel, ' ', b.dn, '. Line ', cast(b.ok % 13 as string)) end as description,
  case when b.ok % 3 = 0 then '' else upper(b.rel) end as keywords
from (
  select l.l_orderkey as ok, cast(l.l_orderkey as bigint) * 8 + l.l_linenumber as seq,
    case when l.l_orderkey % 11 = 0 then 1 else 0 end as swap,
    case k.k when 0 then case when l.l_orderkey % 3 = 0 then 'applicant' when l.l_orderkey % 3 = 1 then 'Brand' else 'company' end
      when 1 then 'product' when 2 then case when l.l_orderkey % 17 = 0 then 'product' else 'model' end when 3 then 'component' when 4 then 'component' when 5 then 'organization' else 'component' end as st,
    case k.k when 0 then case s.s_suppkey % 3 when 0 then concat(s.s_name, ' Inc.') when 1 then upper(concat(s.s_name, ' electronics co., ltd.')) else s.s_name end
      when 1 then p.p_brand when 2 then case when l.l_orderkey % 17 = 0 then p.p_brand else concat(p.p_brand, ' ', p.p_name) end
      when 5 then s.s_name else concat(p.p_type, ' ', cast(p.p_size as string), case when l.l_orderkey % 5 = 0 then '-Module' else ' module' end) end as sn,
    case when l.l_orderkey % 13 = 0 then 'serves' when l.l_orderkey % 13 = 1 then 'linked to' when l.l_orderkey % 13 = 2 then 'has_clause' else
      case k.k when 0 then case l.l_linenumber % 2 when 0 then 'has_product' else 'Produces' end when 1 then 'has_model' when 2 then case l.l_linenumber % 2 when 0 then 'contains' else 'has-component' end
      when 3 then case l.l_linenumber % 2 when 0 then 'complies_with' else 'evaluated against' end when 4 then case l.l_linenumber % 3 when 0 then 'party_role_supplier' else 'manufactured_by' end
      when 5 then 'located_in' else 'has_certification' end end as rel,
    case k.k when 0 then 'product' when 1 then 'model' when 2 then 'component' when 3 then 'standard' when 4 then 'company' when 5 then 'country' else 'certification' end as dt,
    case k.k when 0 then p.p_brand when 1 then concat(p.p_brand, ' ', p.p_name) when 2 then concat(p.p_type, ' ', cast(p.p_size as string), ' module')
      when 3 then concat(case when l.l_orderkey % 2 = 0 then 'IEC ' else 'IEC' end, cast(60000 + p.p_size as string)) when 4 then s.s_name when 5 then n.n_name else concat('Cert ', cast(p.p_size % 7 as string)) end as dn
  from {lineitem} l join {part} p on l.l_partkey = p.p_partkey join {supplier} s on l.l_suppkey = s.s_suppkey join {nation} n on s.s_nationkey = n.n_nationkey
    join (values (0), (1), (2), (3), (4), (5), (6)) as k(k) on k.k = (l.l_orderkey + l.l_linenumber) % 7
) b
"""

#: Pages of documents: one for each line of the text.
PAGES_SPARK = "select doc_id as document_id, source as project_id, concat(source, '.pdf') as source_file, cast(pos + 1 as int) as page_number, col as text from (select doc_id, source, posexplode(split(text, '\n')) from {documents})"
PAGES_SQL = "select doc_id as document_id, source as project_id, concat(source, '.pdf') as source_file, cast(i as int) as page_number, string_split(text, chr(10))[i] as text from (select doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"

#: Pairs of names, some of them variants of one company.
NAME_PAIRS = """
select s_suppkey * 10 + k as id, s_name as left_name,
  case k when 0 then concat(s_name, ' Inc.') when 1 then upper(concat(s_name, ' Electronics Co., Ltd.')) when 2 then concat('Global ', s_name) when 3 then concat(s_name, ' Display')
    when 4 then concat('Acme ', s_name) when 5 then '' when 6 then concat('  ', lower(s_name), '_Corp.') else concat(s_name, ' Systems GmbH') end as right_name
from {supplier} cross join (values (0), (1), (2), (3), (4), (5), (6), (7)) as k(k)
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def as_sql(sql: str) -> str:
    """The same fixture for an engine where the tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()
