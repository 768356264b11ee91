"""Lookups in the graph. Relations name their ends, so dotted targets also count by their leaf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.functions import constants as K
from lodeway.functions import text as X
from lodeway.operators import extract, regex, vectors


def targets(relations: DataFrame) -> DataFrame:
    """Relations once for each name by which their target is found, ``key``: itself and its leaf."""
    return relations.withColumn("key", F.explode(F.array_distinct(F.array("to_name", X.leaf(F.col("to_name"))))))


def find_usages(relations: DataFrame, name: str) -> DataFrame:
    hit = (F.col("to_name") == name) | (X.leaf(F.col("to_name")) == name)
    return relations.where(hit).select("file", "from_name", "relation", "to_name").orderBy("file", "from_name", "relation", "to_name")


def get_callers(relations: DataFrame, name: str) -> DataFrame:
    return find_usages(relations, name).where("relation = 'calls'").select("file", F.col("from_name").alias("caller"))


def file_deps(relations: DataFrame, file: str) -> DataFrame:
    rows = relations.where((F.col("file") == file) & F.col("relation").isin("imports", "inherits", "uses"))
    return rows.select("relation", "from_name", "to_name").orderBy("relation", "from_name", "to_name")


def file_entities(entities: DataFrame, file: str) -> DataFrame:
    return entities.where(F.col("file") == file).select("name", "type", "description", "line_start").orderBy(F.asc_nulls_last("line_start"), "name")


def used_by(entities: DataFrame, relations: DataFrame, file: str, most: int = 5) -> DataFrame:
    """``(name, total, callers)``: outside usages of each definition of a file, by one join."""
    defs = entities.where((F.col("file") == file) & F.col("type").isin(K.EXPLAIN_TYPES)).select(F.col("name").alias("key")).distinct()
    hits = targets(relations.where(F.col("file") != file)).join(defs, "key")
    order = W.partitionBy("key").orderBy("file", "from_name", "relation", "to_name")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    first = F.when(F.col("rank") <= most, F.struct("rank", F.concat_ws(":", "file", "from_name").alias("at")))
    rows = ranked.groupBy("key").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(first)).alias("first"))
    return rows.select(F.col("key").alias("name"), "total", F.array_join(F.transform("first", lambda x: x["at"]), ",").alias("callers"))


def explain(entities: DataFrame, relations: DataFrame, file: str, most: int = 5) -> DataFrame:
    """``(part, name, kind, detail, n)``: what ``file`` defines (n: line), depends on, and who outside uses it (n: in all)."""
    line, none = F.col("line_start").cast("long").alias("n"), F.lit(None).cast("long").alias("n")
    defined = file_entities(entities, file).select(F.lit("defines").alias("part"), "name", F.col("type").alias("kind"), F.col("description").alias("detail"), line)
    needed = file_deps(relations, file).select(F.lit("depends").alias("part"), F.col("to_name").alias("name"), F.col("relation").alias("kind"), F.col("from_name").alias("detail"), none)
    asked = used_by(entities, relations, file, most).select(F.lit("used_by").alias("part"), "name", F.lit(None).cast("string").alias("kind"), F.col("callers").alias("detail"), F.col("total").alias("n"))
    return defined.unionByName(needed).unionByName(asked)


def affected_files(entities: DataFrame, relations: DataFrame, file: str) -> DataFrame:
    """Files to look at when ``file`` changes: those that refer to its names or import it, and itself."""
    names = entities.where(F.col("file") == file).select(F.col("name").alias("to_name")).distinct()
    near = relations.where(F.col("relation").isin(K.REFERENCES)).join(names, "to_name", "left_semi").select("file")
    dotted = relations.where(F.col("to_name").contains(".") & F.col("relation").isin("imports", *K.REFERENCES))
    by_leaf = dotted.withColumn("to_name", X.leaf(F.col("to_name"))).join(names, "to_name", "left_semi").select("file")
    spark = relations.sparkSession
    options = spark.createDataFrame([(file,)], "file string").select(F.explode(X.import_candidates(F.col("file"))).alias("to_name"))
    imports = relations.where("relation = 'imports'").join(options, "to_name", "left_semi").select("file")
    own = spark.createDataFrame([(file,)], "file string")
    return near.union(by_leaf).union(imports).union(own).distinct()


def stats(entities: DataFrame, relations: DataFrame, meta: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """``(metric, n)``: rows of the graph in all and by type, and of its files and cached embeddings where given."""
    by = lambda df, col, head: df.groupBy(col).agg(F.count("*").alias("n")).select(F.concat(F.lit(head), F.col(col)).alias("metric"), "n")
    total = lambda df, head: df.agg(F.count("*").alias("n")).select(F.lit(head).alias("metric"), "n")
    rows = total(entities, "entities").union(total(relations, "relations")).union(by(entities, "type", "type:")).union(by(relations, "relation", "relation:"))
    for df, name in ((meta, "files"), (cache, "embedding_cache")):
        rows = rows.union(total(df, name)) if df is not None else rows
    return rows


def pending(disk: DataFrame, meta: DataFrame) -> DataFrame:
    """``(file, status)`` of files that need work: missing, unindexed, stale or needs_incoming."""
    m = meta.select("file", F.col("mtime").alias("stored"), "incoming_done", F.lit(True).alias("known"))
    d = disk.select("file", "mtime", F.lit(True).alias("there"))
    status = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.col("known").isNull(), "unindexed")
        .when(F.col("mtime") != F.col("stored"), "stale")
        .when(~F.col("incoming_done"), "needs_incoming")
    )
    return d.join(m, "file", "full").select("file", status.alias("status")).where("status is not null")


def build_status(disk: DataFrame, meta: DataFrame) -> DataFrame:
    m = meta.select("file", F.col("mtime").alias("stored"), F.lit(1).alias("known"))
    rows = disk.select("file", "mtime", F.lit(1).alias("there")).join(m, "file", "full")
    both = F.col("there").isNotNull() & F.col("known").isNotNull()
    row = rows.agg(
        F.count("there").alias("total"), F.count("known").alias("indexed"), F.count_if(both).alias("indexed_project"),
        F.count_if(F.col("there").isNull()).alias("deleted"), F.count_if(both & (F.col("mtime") != F.col("stored"))).alias("stale"),
    )
    waits = (F.col("deleted") > 0) | (F.col("stale") > 0) | (F.col("indexed_project") < F.col("total"))
    return row.withColumn("needs_build", waits)


def search_entity(entities: DataFrame, query: str, kind: str | None = None, limit: int = 10, near: list[str] = ()) -> DataFrame:
    """Entities whose name holds tokens of ``query``: most tokens first, then exact, then by prefix, then by name.

    ``near`` lists names that vectors found; they come first. An empty query lists all.
    """
    rows = entities.where(F.col("type") == kind) if kind else entities
    tokens = X.query_tokens(query) or ([query.strip()] if query.strip() else [])
    low = F.lower("name")
    if not tokens:
        return rows.withColumn("hits", F.lit(0)).orderBy("file", F.asc_nulls_last("line_start"), "name").limit(limit)
    hits = sum((low.contains(t.lower()).cast("int") for t in tokens), F.lit(0))
    rank = F.when(low == query.strip().lower(), 0).when(F.startswith(low, F.lit(query.strip().lower())), 1).otherwise(2)
    rows = rows.withColumn("hits", hits).where("hits >= 1").withColumn("rank", rank)
    first = [F.col("name").isin(list(near)).desc()] if near else []
    return rows.orderBy(*first, F.desc("hits"), "rank", "name", "file", "type").limit(limit).drop("rank")


def find_entity(
    entities: DataFrame, query: str, kind: str | None = None, limit: int = 10, embeddings: DataFrame | None = None, encode=None, files: DataFrame | None = None,
) -> DataFrame:
    """``(file, name, type, description, line_start, found)``: entities by name, then by meaning, then places in the texts.

    With ``embeddings`` (name, embedding) and ``encode`` (query -> vector), the
    best 3 ``limit`` by name are ordered anew: names of the ``limit`` nearest
    vectors with a score over 0.3 first, then by name. Where no name fits and no
    ``kind`` is asked for, the names of nearest vectors over 0.1 are looked up
    instead, and where that gives nothing, lines of ``files`` (file, text) with
    the query are listed as symbols. ``found`` is name, vector or text.
    """
    def by_name(text: str, near: list, found: str) -> DataFrame:
        rows = search_entity(entities, text, kind, 3 * limit if embeddings is not None else limit)
        if embeddings is not None:
            first = [F.col("name").isin(near).desc()] if near else []
            rows = rows.orderBy(*first, "name", "file", "type").limit(limit)
        return rows.select("file", "name", "type", "description", F.col("line_start").cast("long").alias("line_start"), F.lit(found).alias("found"))

    near = []
    if embeddings is not None and query.strip():
        near = [(r["name"], r["score"]) for r in vectors.nearest(embeddings, encode(query), limit, "name").collect()]
    rows = by_name(query, [n for n, s in near if s > 0.3], "name")
    if kind or not rows.isEmpty():
        return rows
    close = [n for n, s in near if s > 0.1]
    if close:
        rows = by_name(" ".join(close), close, "vector")
        if not rows.isEmpty():
            return rows
    if files is None or not query.strip():
        return rows
    hits = regex.raw_occurrences(files, query.strip(), limit=limit)
    said = F.lit("Raw text match, no entity of the graph").alias("description")
    return hits.select("file", F.lit(query.strip()).alias("name"), F.lit("symbol").alias("type"), said, F.col("line").cast("long").alias("line_start"), F.lit("text").alias("found"))


def with_places(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (file, name, line_start ...) with ``line_end`` and ``snippet``; those of no known line are located in ``files``."""
    at = extract.locate(rows, files.join(rows.select("file").distinct(), "file", "left_semi"))
    at = at.select("file", "name", F.col("line_start").cast("long").alias("found_at"), F.col("line_end").cast("long").alias("line_end"), "snippet")
    return rows.join(at, ["file", "name"], "left").withColumn("line_start", F.coalesce("line_start", "found_at")).drop("found_at")


def schema(spark) -> DataFrame:
    """``(kind, name, value)``: entity types, aliases and relation types."""
    rows = [("entity_type", t, t) for t in K.ENTITY_TYPES] + [("alias", a, t) for a, t in K.TYPE_ALIASES.items()] + [("relation_type", r, r) for r in K.RELATION_TYPES]
    return spark.createDataFrame(rows, "kind string, name string, value string")
