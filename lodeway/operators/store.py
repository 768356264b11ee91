"""Writes to the graph, each a new snapshot of its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeway.functions import text as X
from lodeway.operators import sanitize
from lodeway.operators.lookup import affected_files
from lodeway.sources.scratch import saver

KEY = ["file", "name", "type"]
EDGE = ["file", "from_name", "relation", "to_name"]


@dataclass(frozen=True)
class Graph:
    """One snapshot: entities (KEY, description, line_start, traits), relations (EDGE), meta (file, mtime, incoming_done).

    Entities may have their line_end and snippet, too.
    """

    entities: DataFrame
    relations: DataFrame
    meta: DataFrame

    def without(self, files: DataFrame) -> Graph:
        """All rows of ``files`` gone."""
        return Graph(*(delete_files(t, files) for t in (self.entities, self.relations, self.meta)))

    def cleared(self) -> Graph:
        return Graph(*(t.limit(0) for t in (self.entities, self.relations, self.meta)))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with ``new`` (file, name, type, description, line_start, traits) merged in.

    An empty description or snippet and a missing line keep the old value;
    traits are replaced. ``old`` decides which columns there are.
    """
    cols = [c for c in old.columns if c not in KEY]
    n = new.select(*KEY, *((F.col(c) if c in new.columns else F.lit(None)).alias(f"new_{c}") for c in cols), F.lit(True).alias("new"))
    value = {c: F.coalesce(f"new_{c}", c) for c in cols}
    for c in {"description", "snippet"} & set(cols):
        value[c] = F.coalesce(F.nullif(f"new_{c}", F.lit("")), c, F.lit(""))
    value["traits"] = F.when(F.col("new"), F.col("new_traits")).otherwise(F.col("traits"))
    return old.join(n, KEY, "full").select(*KEY, *(value[c].cast(old.schema[c].dataType).alias(c) for c in cols))


def definitions_of(entities: DataFrame) -> DataFrame:
    """The ``defines`` relation that storing each entity adds, a file's own included."""
    return entities.select("file", F.col("file").alias("from_name"), F.lit("defines").alias("relation"), F.col("name").alias("to_name")).distinct()


def add_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(relation columns, added)`` of ``new``: whether each was not there."""
    cols = ["file", "from_name", "relation", "to_name"]
    there = old.select(*cols).distinct().withColumn("there", F.lit(True))
    return new.select(*cols).distinct().join(there, cols, "left").select(*cols, F.col("there").isNull().alias("added"))


def delete_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file").distinct(), "file", "left_anti")


def cleaned(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of files that still exist."""
    return rows.join(disk.select("file").distinct(), "file", "left_semi")


def mark_stale(meta: DataFrame, entities: DataFrame, relations: DataFrame, file: str, cascade: bool = True) -> DataFrame:
    """``meta`` with mtime 0 for ``file`` and, with ``cascade``, for the files that depend on it."""
    target = meta.sparkSession.createDataFrame([(file,)], "file string")
    hit = (affected_files(entities, relations, file) if cascade else target).withColumn("hit", F.lit(True))
    return meta.join(hit, "file", "left").select("file", F.when(F.col("hit"), F.lit(0).cast("long")).otherwise(F.col("mtime")).alias("mtime"), F.coalesce("hit", F.lit(False)).alias("marked"))


def mark_seen(meta: DataFrame, files: DataFrame) -> DataFrame:
    """``meta`` with the mtime of ``files`` (file, mtime), which need nothing more."""
    seen = files.select("file", F.col("mtime").cast("long").alias("mtime"), F.lit(True).alias("incoming_done"))
    return delete_files(meta, files).select("file", "mtime", "incoming_done").unionByName(seen)


def file_entities(files: DataFrame) -> DataFrame:
    """The entity of each file itself."""
    kind = X.file_kind(F.col("file"))
    said = F.when(kind == "module", "Source file").otherwise(F.concat(F.initcap(kind), F.lit(" file")))
    none = F.lit(None).cast("long")
    return files.select("file", F.col("file").alias("name"), kind.alias("type"), said.alias("description"), none.alias("line_start"), F.lit("").alias("traits"))


def _stored(graph: Graph, entities: DataFrame, relations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations with those of ``files`` merged in, and the new relations that are not dropped."""
    own = file_entities(files).join(graph.entities.select("file", "name").distinct(), ["file", "name"], "left_anti")
    entities = entities.select(*KEY, *(c for c in graph.entities.columns if c not in KEY and c in entities.columns))
    new = entities.unionByName(allowMissingColumns=True, other=own.join(entities.select("file", "name").distinct(), ["file", "name"], "left_anti"))
    known = new.select("file", "name").unionByName(graph.entities.select("file", "name"))
    kept = sanitize.without_weaker(sanitize.relations(relations, known).select(*EDGE))
    edges = graph.relations.select(*EDGE).unionByName(kept).unionByName(definitions_of(new)).distinct()
    return upsert_entities(graph.entities, new), edges, kept


def write_batch(graph: Graph, batch: DataFrame, entities: DataFrame, relations: DataFrame, disk: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after a validated write of many files, and ``(file, status, relations_dropped, needs_incoming)``.

    ``batch`` lists the files as ``batch_status`` takes them. Files that cannot
    be indexed or are missing lose their rows, rejected ones keep them, those
    with entities are replaced, others added to. A source file that was
    replaced needs its incoming references next.
    """
    # Written once, one row a file: of known size, so that where files are few it is broadcast, and their many rows are not dealt by file.
    status = saver(batch.sparkSession)(batch_status(batch, disk))
    writing = status.where(F.col("status").isin("replaced", "added")).select("file")
    base = graph.without(status.where(F.col("status").isin("skipped", "missing", "replaced")).select("file"))
    of = lambda rows: rows.join(writing, "file", "left_semi")
    merged, edges, kept = _stored(base, of(entities), of(relations), writing)
    code = X.file_kind(F.col("file")) == "module"
    counts = relations.groupBy("file").agg(F.count("*").alias("n")).join(kept.groupBy("file").agg(F.count("*").alias("k")), "file", "left")
    report = status.join(counts, "file", "left").select(
        "file", "status", F.when(F.col("status").isin("replaced", "added"), F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(F.col("k"), F.lit(0))).otherwise(0).alias("relations_dropped"),
        ((F.col("status") == "replaced") & code).alias("needs_incoming"),
    )
    seen = report.where(F.col("status").isin("replaced", "added")).join(disk.select("file", "mtime"), "file")
    seen = seen.select("file", F.col("mtime").cast("long").alias("mtime"), (~F.col("needs_incoming")).alias("incoming_done"))
    meta = delete_files(base.meta, seen).select("file", "mtime", "incoming_done").unionByName(seen)
    return Graph(merged, edges, meta), report


def add_entity(graph: Graph, file: str, name: str, kind: str, mtime: int, description: str = "", tags: list[str] = ()) -> Graph:
    """One entity merged in without a wipe, and that of its file where there is none; the file then counts as done."""
    spark = graph.entities.sparkSession
    row = spark.createDataFrame([(file, name, kind, description, ",".join(tags))], "file string, name string, kind string, description string, tags string")
    clean = X.sanitized_tags(F.col("tags"))
    detected = X.traits(F.col("name"), F.lit(""), F.col("file"), F.col("type"))
    row = row.withColumn("type", X.canonical_type(F.col("kind")))
    row = row.select(*KEY, "description", F.lit(None).cast("long").alias("line_start"), X.united_traits(detected, clean).alias("traits"))
    merged, edges, _ = _stored(graph, row, graph.relations.limit(0), row.select("file"))
    return Graph(merged, edges, mark_seen(graph.meta, row.select("file", F.lit(mtime).alias("mtime"))))


def cache_hit_rate(rows: DataFrame, cache: DataFrame, key: str = "hash") -> DataFrame:
    """``(total, hits, rate)`` of the keys that ``cache`` holds; no keys have rate 0."""
    there = cache.select(key).distinct().withColumn("hit", F.lit(1))
    row = rows.join(there, key, "left").agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    return row.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("total")), F.lit(0.0)), 4))


def batch_status(batch: DataFrame, disk: DataFrame) -> DataFrame:
    """``(file, status)`` of files offered for writing as (file, n_entities, n_relations, module_only, completes)."""
    there = disk.select("file").distinct().withColumn("there", F.lit(True))
    rows = batch.join(there, "file", "left")
    code = X.file_kind(F.col("file")) == "module"
    status = (
        F.when(~X.is_indexable(F.col("file")), "skipped")
        .when(F.col("there").isNull(), "missing")
        .when(code & (F.col("n_entities") > 0) & (F.col("n_relations") == 0) & ~F.col("module_only"), "rejected")
        .when((F.col("n_entities") == 0) & (F.col("n_relations") == 0) & ~F.col("completes"), "rejected")
        .when(F.col("n_entities") > 0, "replaced")
        .otherwise("added")
    )
    return rows.select("file", status.alias("status"))


def backfilled(entities: DataFrame) -> DataFrame:
    """Entities with traits detected anew; tags are dropped."""
    return entities.withColumn("traits", F.concat_ws(" ", X.traits(F.col("name"), F.col("snippet"), F.col("file"), F.col("type"))))
