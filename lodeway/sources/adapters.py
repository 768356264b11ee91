"""Views of the relational tables as a knowledge graph, files and chunks.

Each view is one SELECT in the common part of Spark SQL and ANSI SQL; table
names stand in braces, so that the same text also serves other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CUSTOMER_FILE = "'app/crm/' || lower(c_mktsegment) || '/n' || cast(c_nationkey as string) || '.py'"
SUPPLIER_FILE = (
    "case when s_suppkey % 4 = 0 then 'tests/supply/test_n' || cast(s_nationkey as string) || '.py' "
    "else 'svc/supply/n' || cast(s_nationkey as string) || '.ts' end"
)
PART_FILE = "'lib/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '.ts'"
CUSTOMER, SUPPLIER, PART = "'Customer' || cast(c_custkey as string)", "'supply_' || cast(s_suppkey as string)", "replace(p_name, ' ', '_')"

DEFINITIONS = f"""
  select {CUSTOMER_FILE} as file, {CUSTOMER} as name, 'class' as type, c_mktsegment as description, cast(c_custkey as bigint) as line_start from {{customer}}
  union all select {SUPPLIER_FILE}, {SUPPLIER}, 'function', 'supplier', cast(s_suppkey as bigint) from {{supplier}}
  union all select {PART_FILE}, {PART}, 'component', min(p_type), cast(min(p_partkey) as bigint) from {{part}} group by {PART_FILE}, {PART}
"""
ENTITIES = f"""
select file, name, type, description, line_start, case when type = 'class' then 'exported' when file like 'tests/%' then 'async test'
  when line_start % 3 = 0 then 'async' else '' end as traits
from ({DEFINITIONS}) d
union all select distinct file, file, 'module', 'Module file', cast(null as bigint), '' from ({DEFINITIONS}) d
"""
RELATIONS = f"""
select distinct file, from_name, relation, to_name from (
  select {CUSTOMER_FILE} as file, {CUSTOMER} as from_name, 'calls' as relation, {SUPPLIER} as to_name
    from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey join {{supplier}} on l_suppkey = s_suppkey
    where l_linenumber = 1
  union all select {CUSTOMER_FILE}, {CUSTOMER}, 'uses', {PART}
    from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey join {{part}} on l_partkey = p_partkey
    where l_linenumber = 2
  union all select {SUPPLIER_FILE}, {SUPPLIER}, case when s_suppkey % 2 = 0 then 'calls' else 'inherits' end, {CUSTOMER}
    from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey join {{supplier}} on l_suppkey = s_suppkey
    where o_orderpriority = '1-URGENT' and l_linenumber = 1
  union all select {CUSTOMER_FILE}, {CUSTOMER}, 'imports', 'pkg.nation.' || n_name from {{customer}} join {{nation}} on c_nationkey = n_nationkey
  union all select {CUSTOMER_FILE}, {CUSTOMER}, 'imports', 'svc.supply.supply_' || cast(c_custkey % 50 as string) from {{customer}} where c_custkey % 5 = 0
  union all select file, file, 'defines', name from ({ENTITIES}) e
) r
"""
FILES = "select source || '/' || cast(doc_id as string) || '.' || lang as file, text from {documents}"
FILE_META = """
select 'src/u' || cast(user_id as string) || '.py' as file, cast(max(event_id) as bigint) as mtime,
  min(event_type) <> 'click' as incoming_done from {events} where user_id % 10 <> 3 group by user_id
"""
DISK = """
select 'src/u' || cast(user_id as string) || '.py' as file, cast(max(event_id) as bigint) as mtime from {events} where user_id % 10 <> 7
  and (user_id % 10 < 5 or event_id % 2 = 0) group by user_id
"""
VIEWS = {"entities": ENTITIES, "relations": RELATIONS, "files": FILES, "file_meta": FILE_META, "disk": DISK}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations labels benchmark".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the Parquet tables below ``sf_dir``."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain_sql(name: str) -> str:
    """The text of a view with the plain table names."""
    return VIEWS[name].format(**{t: t for t in TABLES})
