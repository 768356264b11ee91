"""Results as text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeway.functions import text as X

def code_results(rows: DataFrame, preview: int = 1500) -> DataFrame:
    """``(chunk_id, block)`` of ranked chunks (file, line_start, text, score)."""
    last = F.col("line_start") + F.size(F.split("text", "\n", -1)) - 1
    head = F.format_string("%s lines=%d-%d score=%.4f", "file", "line_start", last, "score")
    return rows.select("chunk_id", F.concat(head, F.lit("\n"), F.substring("text", 1, preview)).alias("block"))


def entity_results(rows: DataFrame) -> DataFrame:
    """``(file, name, block)`` of entities (file, name, type, description, line_start, line_end, snippet): a head line, then the snippet, indented."""
    end = F.when(F.col("line_end") != F.col("line_start"), F.concat(F.lit("-"), F.col("line_end"))).otherwise("")
    place = F.concat("file", F.coalesce(F.concat(F.lit(":"), F.col("line_start"), F.coalesce(end, F.lit(""))), F.lit("")))
    said = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise("")
    body = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n      "), F.array_join(X.lines(F.col("snippet")), "\n      "))).otherwise("")
    head = F.concat(F.lit("  • ["), F.col("type"), F.lit("] "), F.col("name"), said, F.lit("  ("), place, F.lit(")"))
    return rows.select("file", "name", F.concat(head, body).alias("block"))


def relation_lines(relations: DataFrame, indent: str = "    ") -> DataFrame:
    """``(file, from_name, relation, line)``: the targets of each entity by relation, on one line."""
    rows = relations.groupBy("file", "from_name", "relation").agg(F.array_sort(F.collect_set("to_name")).alias("names"))
    return rows.select("file", "from_name", "relation", F.concat(F.lit(indent), F.col("relation"), F.lit(": "), F.array_join("names", ", ")).alias("line"))


def section(rows: DataFrame, title: str, line: str, order: str) -> DataFrame:
    """``(section)``, one row: the title, and the lines of an answer that are not empty, in order."""
    kept = F.when(F.coalesce(line, F.lit("")) != "", F.struct(order, line))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda r: r[line]), "\n")
    return rows.agg(F.concat_ws("\n", F.lit(title + ":"), F.nullif(body, F.lit(""))).alias("section"))


def scored_notes(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, line)`` of notes (conv_id, turn, role, text, score)."""
    return rows.select("conv_id", "turn", F.format_string("  [%s] score=%.2f %s", "role", "score", F.substring("text", 1, 120)).alias("line"))


def entity_location(rows: DataFrame) -> DataFrame:
    """``(file, name, place)``: file:start-end, as far as known."""
    end = F.when(F.col("line_end").isNotNull(), F.concat(F.lit("-"), F.col("line_end"))).otherwise("")
    place = F.concat("file", F.coalesce(F.concat(F.lit(":"), F.col("line_start"), end), F.lit("")))
    return rows.select("file", "name", place.alias("place"))


def memory_listing(rows: DataFrame, preview: int = 80) -> DataFrame:
    """``(role, n, newest, listing)`` of notes (conv_id, turn, role, text): grouped by kind, the newest first."""
    from pyspark.sql import Window as W

    order = W.partitionBy("role").orderBy(F.desc("conv_id"), F.desc("turn"))
    first = rows.withColumn("rank", F.row_number().over(order))
    line = F.when(F.col("rank") <= 5, F.struct("rank", F.substring(F.regexp_replace("text", r"\s+", " "), 1, preview).alias("line")))
    out = first.groupBy("role").agg(F.count("*").alias("n"), F.max("conv_id").alias("newest"), F.array_sort(F.collect_list(line)).alias("lines"))
    return out.select("role", "n", "newest", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("listing"))
