"""The graph of a source tree: built at once, or brought up to date for the files that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.functions import constants as K
from lodeway.functions import text as X
from lodeway.operators import extract, lookup, sanitize, store
from lodeway.operators.store import Graph
from lodeway.sources import files as sources
from lodeway.sources.scratch import children, delete, exists, saver

ENTITIES = "file string, name string, type string, description string, line_start long, line_end long, snippet string, traits string"
RELATIONS = "file string, from_name string, relation string, to_name string"
META = "file string, mtime long, incoming_done boolean"


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (ENTITIES, RELATIONS, META)))


def brought_up_to_date(graph: Graph, files: DataFrame, extractor: Callable[[str, str], dict], force: bool = False, most: int | None = None, rules: bool = False) -> tuple[Graph, DataFrame]:
    """The graph after indexing ``files`` (file, mtime, length, text), and one row of counts.

    Rows of files that are gone go. Files without or with another mtime in the
    graph's meta are read, all of them with ``force``, the first ``most`` by
    name. Secret, large and nearly empty ones are marked as seen and never
    shown to the extractor; a file of which it tells nothing stays unindexed,
    for a later try. Entities are located in their files, and their traits read
    from the lines around. With ``rules``, stylesheets, configurations and
    templates go to ``extract.structured`` instead of the extractor.
    """
    save = saver(files.sparkSession)
    known = graph.meta.select("file").distinct()
    deleted = known.join(files.select("file"), "file", "left_anti")
    now = Graph(*(store.cleaned(t, files) for t in (graph.entities, graph.relations, graph.meta)))
    work = lookup.pending(files, now.meta.withColumn("incoming_done", F.lit(True))).select("file") if not force else files.select("file")
    work = save(work.orderBy("file").limit(most) if most is not None else work)
    rows = files.join(work, "file", "left_semi")
    text = F.coalesce("text", F.lit(""))
    quiet = X.is_secret(F.col("file")) | (F.col("length") > K.MAX_FILE_BYTES) | (F.length(F.trim(text)) < K.MIN_CHARS)
    asked = rows.where(~quiet)
    by_rule = extract.strategy(F.col("file")) != "model" if rules else F.lit(False)
    told = save(sources.extract_with(asked.where(~by_rule), extractor))
    flat = told.select("file", F.inline("entities")).select("file", "name", "type", "description", "tags")
    relations = told.select("file", F.inline("relations")).select("file", "from_name", "relation", "to_name")
    found = told.where((F.size("entities") > 0) | (F.size("relations") > 0)).select("file")
    if rules:
        named, links = map(save, extract.structured(asked.where(by_rule)))
        none = F.lit(None).cast("string")
        flat = flat.unionByName(named.select("file", "name", "type", none.alias("description"), none.alias("tags")))
        relations, found = relations.unionByName(links), found.union(named.select("file")).union(links.select("file")).distinct()
    entities = save(sanitize.entities(flat).withColumn("line_start", F.lit(None).cast("long")))
    entities = lookup.with_places(entities, asked.select("file", "text"))
    detected = X.traits(F.col("name"), F.col("snippet"), F.col("file"), F.col("type"))
    traits = X.united_traits(detected, F.col("tags")).alias("traits")
    entities = save(entities.select("file", "name", "type", "description", "line_start", "line_end", F.coalesce("snippet", F.lit("")).alias("snippet"), traits))
    wiped = now.without(rows.where(~quiet).select("file"))
    merged, edges, _ = store._stored(wiped, entities, relations, found)
    seen = rows.where(quiet).select("file", "mtime").unionByName(rows.join(found, "file", "left_semi").select("file", "mtime"))
    out = Graph(*map(save, (merged, edges, store.mark_seen(wiped.meta, seen))))
    total = lambda df, name: df.agg(F.count("*").alias(name))
    counts = total(work, "indexed")
    pending = lookup.pending(files, out.meta)
    for df, name in ((deleted, "deleted"), (pending, "remaining"), (out.meta, "total_files"), (out.entities, "entities"), (out.relations, "relations")):
        counts = counts.crossJoin(F.broadcast(total(df, name)))
    return out, counts


class GraphStore:
    """Snapshots of a graph below a folder; the newest finished one counts, and writers never touch it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[str]:
        return [p for p in children(self.spark, self.folder) if p.rpartition("/")[2].startswith("v") and exists(self.spark, f"{p}/meta/_SUCCESS")]

    def read(self) -> Graph:
        last = self._versions()[-1:]
        if not last:
            return empty(self.spark)
        return Graph(*(self.spark.read.parquet(f"{last[0]}/{t}") for t in ("entities", "relations", "meta")))

    def write(self, graph: Graph) -> Graph:
        """A new snapshot; its meta is written last and finishes it. Of the older ones the last stays."""
        before = self._versions()
        n = int(before[-1].rpartition("/v")[2]) + 1 if before else 0
        for name, df in (("entities", graph.entities), ("relations", graph.relations), ("meta", graph.meta)):
            df.write.mode("overwrite").parquet(f"{self.folder}/v{n:08d}/{name}")
        for old in before[:-1]:
            delete(self.spark, old)
        return self.read()

    def build(self, root: str, extractor: Callable[[str, str], dict], config=None, force: bool = False, most: int | None = None, rules: bool = False) -> dict:
        """Scan ``root`` and index what changed; the counts."""
        files = saver(self.spark)(sources.scan(self.spark, root, config, secrets=True))
        graph, counts = brought_up_to_date(self.read(), files, extractor, force, most, rules)
        self.write(graph)
        return counts.first().asDict()

    def index_file(self, root: str, file: str, extractor: Callable[[str, str], dict], config=None, force: bool = False, rules: bool = False) -> dict:
        """One file of ``root`` brought up to date, the others untouched."""
        old, only = self.read(), F.col("file") == file
        files = saver(self.spark)(sources.scan(self.spark, root, config, secrets=True).where(only))
        part, counts = brought_up_to_date(Graph(*(t.where(only) for t in (old.entities, old.relations, old.meta))), files, extractor, force, rules=rules)
        rest = Graph(*(t.where(~only) for t in (old.entities, old.relations, old.meta)))
        names = ("entities", "relations", "meta")
        self.write(Graph(*(getattr(rest, n).unionByName(getattr(part, n)) for n in names)))
        return counts.first().asDict()

    def clear(self) -> Graph:
        return self.write(self.read().cleared())
