"""BM25, literal bonus and hybrid ranking over chunks (chunk_id, file, line_start, text)."""

from __future__ import annotations

import hashlib
import logging
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeway.functions import text as X
from lodeway.sources.scratch import children, delete, exists, shared_dir, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, term, tf, dl)``, with the length of the chunk in tokens.

    Equal tokens are neighbours in the sorted ones, so a chunk counts its own
    without an exchange.
    """

    def counted(ts):
        n = F.size(ts)
        starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
        run = lambda ends: F.transform(
            ends, lambda i, k: F.struct(F.get(ts, i).alias("term"), n.cast("long").alias("dl"), (F.coalesce(F.get(ends, k + 1), n) - i).cast("long").alias("tf"))
        )
        return X.let(starts, run)

    return chunks.select("chunk_id", F.inline(X.let(F.sort_array(X.tokens(F.col("text"))), counted))).select("chunk_id", "term", "dl", "tf")


@dataclass
class SearchIndex:
    """What a search reads of ``chunks``: postings in the order of terms, statistics of terms, and of the corpus."""

    chunks: DataFrame
    postings: DataFrame  # chunk_id, term, dl, tf
    terms: DataFrame  # term, df, tf, idf
    n: int
    mean_length: float
    floor: float  # of the idf

    @classmethod
    def opened(cls, chunks: DataFrame, folder: str) -> SearchIndex:
        read = chunks.sparkSession.read.parquet
        row = read(f"{folder}/corpus").first()
        return cls(chunks, read(f"{folder}/postings"), read(f"{folder}/terms"), row["n"], row["mean_length"], row["floor"])


def fingerprint(files: DataFrame, *params) -> str:
    """Names an index by its files (file, mtime, length) and parameters, whatever their order."""
    row = files.agg(F.count("*"), F.bit_xor(F.xxhash64("file", "mtime", "length")), F.sum(F.xxhash64("length", "file", "mtime").cast("decimal(38,0)"))).first()
    return hashlib.md5(repr((*row, *params, K1, B)).encode()).hexdigest()


def build_index(chunks: DataFrame, folder: str) -> SearchIndex:
    """Tokenise ``chunks`` once and write their postings, sorted by term so that a query reads few of them.

    Ranges are drawn from a sample of postings, so these are written unsorted
    before; otherwise every text would be tokenised for the sample, too.
    """
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = f"{folder}/unsorted"
    postings(spread(chunks)).write.mode("overwrite").option("compression", "zstd").parquet(raw)
    rows = spark.read.parquet(raw).repartitionByRange(parts, "term").sortWithinPartitions("term", "chunk_id")
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{folder}/postings")
    delete(spark, raw)
    posted = spark.read.parquet(f"{folder}/postings")
    n = chunks.count()
    terms = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    idf = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms.withColumn("idf", idf).write.mode("overwrite").parquet(f"{folder}/terms")
    row = spark.read.parquet(f"{folder}/terms").agg(F.sum("tf").alias("words"), F.avg("idf").alias("mean")).first()
    corpus = [(n, float(row["words"] or 0) / n if n else 0.0, EPSILON * (row["mean"] or 0.0))]
    spark.createDataFrame(corpus, "n long, mean_length double, floor double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/corpus")
    return SearchIndex.opened(chunks, folder)  # the corpus comes last, so a folder with it is whole


def index_of(chunks: DataFrame, name: str, key: str, base: str | None = None) -> SearchIndex:
    """The index ``name`` of fingerprint ``key``: from its folder, else built anew, which evicts the older ones of that name.

    An empty corpus has an empty index, never an older one.
    """
    spark = chunks.sparkSession
    home = f"{base or shared_dir(spark)}/search-{name}"
    if exists(spark, f"{home}/{key}/corpus/_SUCCESS"):
        return SearchIndex.opened(chunks, f"{home}/{key}")
    for old in children(spark, home):
        if old.rpartition("/")[2] != key:
            delete(spark, old)
    return build_index(chunks, f"{home}/{key}")


def bm25(index: SearchIndex, query: str) -> DataFrame:
    """``(chunk_id, bm25)`` of the chunks with a term of ``query``; a term counts as often as the query has it.

    Terms in over half of the chunks take a fraction of the mean idf of all terms.
    """
    asked = Counter(X.query_terms(query))
    idf = {r["term"]: r["idf"] for r in index.terms.where(F.col("term").isin(list(asked))).collect()} if asked else {}
    if not idf:
        return index.postings.limit(0).select("chunk_id", F.lit(0.0).alias("bm25"))
    weight = {t: asked[t] * (index.floor if v < 0 else v) for t, v in sorted(idf.items())}
    value = F.element_at(F.create_map(*(F.lit(x) for kv in weight.items() for x in kv)), F.col("term"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length)))
    hits = index.postings.where(F.col("term").isin(list(weight)))
    return hits.groupBy("chunk_id").agg(F.sum(value * gain).alias("bm25"))


def top(rows: DataFrame, score: str, k: int, key: str = "chunk_id") -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(k)


def literal_weights(chunks: DataFrame, literals: list[str]) -> DataFrame:
    """``(literal, df, idf)`` with idf = ln(N / max(df, 1)), in one pass over the chunks."""
    low = F.lower("text")
    counts = chunks.agg(F.count("*").alias("n"), *(F.count_if(low.contains(x.lower())).alias(f"c{i}") for i, x in enumerate(literals)))
    pairs = F.array(*(F.struct(F.lit(x).alias("literal"), F.col(f"c{i}").alias("df")) for i, x in enumerate(literals)))
    rows = counts.select("n", F.inline(pairs)) if literals else counts.select("n", F.lit("").alias("literal"), F.lit(0).alias("df")).limit(0)
    return rows.select("literal", "df", F.log(F.col("n") / F.greatest("df", F.lit(1))).alias("idf"))


def hybrid(
    index: SearchIndex, dense: DataFrame, query: str, first: int = 60, final: int = 8, reranker=None
) -> DataFrame:
    """The best ``final`` chunks by BM25, ``dense`` (chunk_id, dense) scores and literals of ``query``.

    Candidates are the ``first`` of each ranking and all chunks with a literal;
    their score is half the BM25 score over the best one plus half the dense
    score, either 0 outside its ranking. A ``reranker`` (query, texts -> scores)
    rescores the best max(8 final, 60) and adds the literals' weights; where it
    fails, which is logged, the order stays.
    """
    chunks, lexical = index.chunks, bm25(index, query)
    literals = X.query_literals(query)
    near = {r["chunk_id"]: r["dense"] for r in top(dense, "dense", first).collect()}
    head = [(r["chunk_id"], r["bm25"]) for r in top(lexical, "bm25", first).collect()]
    best = head[0][1] if head else 0.0
    scale = best if best > 0 else 1.0
    if len(head) < first or head[-1][1] < 0:  # chunks without a term score 0
        rest = chunks.select("chunk_id").join(lexical, "chunk_id", "left_anti").orderBy("chunk_id").limit(first).collect()
        head = sorted(head + [(r["chunk_id"], 0.0) for r in rest], key=lambda x: (-x[1], x[0]))[:first]
    low = F.lower("text")
    wanted = F.col("chunk_id").isin(sorted({*near, *(c for c, _ in head)}))
    for x in literals:
        wanted = wanted | low.contains(x.lower())
    close = chunks.sparkSession.createDataFrame(list(near.items()), T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("dense", T.DoubleType())]))
    rows = chunks.where(wanted).join(lexical, "chunk_id", "left").join(F.broadcast(close), "chunk_id", "left")  # ``first`` rows
    score = 0.5 * F.coalesce(F.col("bm25") / scale, F.lit(0.0)) + 0.5 * F.coalesce("dense", F.lit(0.0))
    rows = rows.select("chunk_id", "file", "line_start", "text", score.alias("score"))
    if reranker is None:
        return top(rows, "score", final)
    pool = top(rows, "score", max(8 * final, 60))
    weights = {r["literal"]: r["idf"] for r in literal_weights(chunks, literals).collect()}
    bonus = sum((F.when(low.contains(x.lower()), w).otherwise(0.0) for x, w in weights.items()), F.lit(0.0))
    schema = T.StructType([*pool.schema.fields, T.StructField("ce", T.DoubleType())])

    def rescored(batches):
        for b in batches:
            try:
                ce = [float(x) for x in reranker(query, list(b["text"]))]
            except Exception:
                logging.getLogger(__name__).warning("the reranker failed", exc_info=True)
                ce = [0.0] * len(b)
            yield b.assign(ce=ce)

    pool = pool.mapInPandas(rescored, schema)
    return top(pool.withColumn("score", 0.65 * F.col("ce") + 0.35 * F.col("score") + 0.2 * bonus).drop("ce"), "score", final)
