"""The corpus pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm import decontaminate, mixing, nearcopies, sharding, toxicity
from lodeway.llm.common import Scratch, possibly_in, table
from lodeway.llm.queries import HELD_OUT

#: Score from which a document is rejected.
TOXIC = 0.7
SHARDS = 8
#: Near copies: words of a shingle, differing bits of fingerprints that make a candidate, and the share of common
#: shingles from which a candidate is a near copy.
SHINGLE, NEAR_BITS, ALIKE = 5, 4, 0.8
WORD = r"[^\x20\x09-\x0D]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the model never sees the held-out labels."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"), f"not ({HELD_OUT})")
    scored = toxicity.scored(spark, docs.withColumn("_doc", F.struct(*docs.columns)).select("_doc", "text"), model)
    return scored.where(F.col("toxicity") < TOXIC).select("_doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as ``_doc``, with a narrow identity: doc_id as a long, and the hash of the text."""
    key = {"_d": F.col("doc_id").cast("long"), "_t": F.xxhash64("text")}
    return docs.select(F.struct(*docs.columns).alias("_doc"), *(c.alias(k) for k, c in key.items()))


def _without(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_keyed`` documents apart from those ``gone`` (_d, _t): such as are surely not among them, and the rest.

    Only the rest, about as many as are gone, is exchanged; the texts of the others stay where they are.
    """
    keyed = _keyed(docs).withColumn("_i", F.xxhash64("_d", "_t"))
    keyed = possibly_in(keyed, "_i", gone.select(F.xxhash64("_d", "_t").alias("_i")))
    named = gone.select(F.col("_d").alias("_gd"), F.col("_t").alias("_gt")).distinct()
    same = F.col("_d").eqNullSafe(F.col("_gd")) & (F.col("_t") == F.col("_gt"))
    return keyed.where("not _maybe"), keyed.where("_maybe").join(named, same, "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate group, once; rows without doc_id stay."""
    found = nearcopies.near_copies(spark, docs.where("doc_id is not null").select("doc_id", "text"), ALIKE, SHINGLE, NEAR_BITS)
    found = Scratch(spark, "copies").save(found.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "kept"))
    gone = found.where("not kept").select("_d", "_t").distinct()
    again = Scratch(spark, "copies").save(found.where("kept").groupBy("_d", "_t").agg(F.count("*").alias("_n")).where("_n > 1").select("_d", "_t"))
    clear, rest = _without(docs, gone)
    if not again.isEmpty():  # rows alike in doc_id and text, of which one stays
        one, more = _without(clear.unionByName(rest).select("_doc.*"), again)
        repeated = _keyed(docs).join(again, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"])
        return one.select("_doc.*").unionByName(more.select("_doc.*")).unionByName(repeated.select("_doc.*"))
    return clear.select("_doc.*").unionByName(rest.select("_doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window, and of which shorter items cover less than a twentieth."""
    found = decontaminate.benchmark_overlap(spark, docs, table(spark, sf_dir, "benchmark"))
    found = Scratch(spark, "overlap").save(found)  # else a filter on it would be derived twice
    hit = decontaminate.contaminated() | (F.col("n_hit") >= decontaminate.WINDOW)
    gone = Scratch(spark, "contaminated").save(found.where(hit).select(F.col("doc_id").cast("long").alias("_d"), F.col("text_key").alias("_t")).distinct())
    clear, rest = _without(docs, gone)
    return clear.select("_doc.*").unionByName(rest.select("_doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; documents without words are not taken."""
    mix = mixing.planned(spark, Scratch(spark, "mixed").save(mixing.measured(docs)))
    rows = docs.where(F.col("text").rlike(WORD)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "source", F.struct(*docs.columns).alias("_doc")
    )
    taken = mix.taken(rows).where("times > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_again")).select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, in shards of nearly equal bytes."""
    return sharding.sharded(spark, docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: A trained model and a flow decide, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
