"""The registered queries of the operators and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm import decontaminate, extraction, mixing, pivots, secrets, sharding, simhash, substrings, toxicity, urls
from lodeway.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark, table(spark, sf_dir, "pages"))


#: The rows whose labels the query never learns from.
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"), f"not ({HELD_OUT})")
    found = toxicity.scored(spark, docs, model)
    return found.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.sharded(spark, docs, 8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(spark, table(spark, sf_dir, "documents"), digest=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.told(F.col("base")), 256).alias("base_sha256"),
        secrets.told(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_duplicates(spark, table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_overlap(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_toxicity,
        op3_simhash_near_dedup,
        op4_histogram_sharding,
        op5_html_extraction,
        op6_substring_dedup,
        op7_secret_scan,
        op8_embedding_near_dedup,
        op9_source_mixing,
        op10_benchmark_decontamination,
    )
}

_BENCH_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: SQL of the queries that it can express: not models, flows, iterated propagation or seeded XXH64.
ORACLE_SQL: dict[str, str] = {
    "op6_substring_dedup": f"""with w as materialized (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
      win as materialized (select rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
      firsts as (select h, min(doc_id) as first from win group by h),
      gone as materialized (select distinct rid, unnest(range(i, i + 50)) as p from win join firsts using (h) where first < doc_id),
      kept as (select x.rid, string_agg(x.word, ' ' order by x.p) as kept from (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as p from w) x
        left join gone g on x.rid = g.rid and x.p = g.p where g.rid is null group by x.rid),
      n as (select rid, count(*) as n from gone group by rid)
      select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (rid) left join n using (rid)""",
    "op8_embedding_near_dedup": """with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
      l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        where list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
      walk(id, root) as (select vec_id, vec_id from embeddings union select l.b, root from walk join l on l.a = id),
      c as (select id, min(root) as root from walk group by id), n as (select a, count(*) as n from l group by a)
      select vec_id, coalesce(n, 0) as n_links, root as component_id, vec_id = root as kept from embeddings join c on id = vec_id left join n on a = vec_id""",
    "op10_benchmark_decontamination": f"""with w as materialized (select row_number() over () as rid, doc_id, {_BENCH_WORDS} as ws from documents),
      b as (select item_id, ws, least(13, len(ws)) as n from (select item_id, {_BENCH_WORDS} as ws from benchmark where item_id is not null) where len(ws) > 0),
      bw as materialized (select distinct item_id, n, md5(array_to_string(ws[i:i + n - 1], ' ')) as h from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from b)),
      dw as (select rid, n, i, md5(array_to_string(ws[i:i + n - 1], ' ')) as h from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bw))),
      hit as materialized (select rid, i, n, item_id from dw join bw using (n, h)),
      p as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + n)) from hit) group by rid),
      t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from hit) group by rid)
      select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
      coalesce(n_hit > 0 and 20 * n_hit >= len(ws), false) as contaminated from w left join p using (rid) left join t using (rid)""",
}
