"""Roll-ups for display: edges between files and modules, and summaries of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.functions import constants as K
from lodeway.functions import text as X


def single_definitions(entities: DataFrame) -> DataFrame:
    """``(name, file)`` of names that are defined in one file, or once more elsewhere."""
    rows = entities.where(F.col("type").isin(K.VIEW_TYPES) & (F.length("name") >= 2))
    first = rows.groupBy("name").agg(F.min("file").alias("first"))
    counted = rows.join(first, "name").groupBy("name", "first").agg(F.count_if(F.col("file") != F.col("first")).alias("others"))
    return counted.where("others < 2").select("name", F.col("first").alias("file"))


def file_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: relations from a file to names of another."""
    defs = single_definitions(entities).select(F.col("name").alias("to_name"), F.col("file").alias("dst"))
    rows = relations.where(F.col("relation").isin("calls", "uses", "imports", "instantiates", "inherits")).join(defs, "to_name")
    return rows.where("file != dst").groupBy(F.col("file").alias("src"), "dst").agg(F.count("*").alias("weight"))


def module_edges(edges: DataFrame, depth: int = 3) -> DataFrame:
    rows = edges.select(X.module_of(F.col("src"), depth).alias("src"), X.module_of(F.col("dst"), depth).alias("dst"), "weight")
    return rows.where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def file_summary(entities: DataFrame, most: int = 50) -> DataFrame:
    """``(file, total, names)``: the first definitions of each file by line and name."""
    total = entities.groupBy("file").agg(F.count("*").alias("total"))
    shown = F.col("type").isin(K.VIEW_TYPES) & (F.length("name") > 1) & (F.col("name") != F.col("file"))
    shown = shown & ~((F.col("type") == "module") & F.col("name").contains("/"))
    order = W.partitionBy("file").orderBy(F.coalesce("line_start", F.lit(0)), "name", "type")
    rows = entities.where(shown).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    rows = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("first"))
    return total.join(rows, "file", "left").select("file", "total", F.coalesce(F.array_join(F.transform("first", lambda x: x["name"]), ","), F.lit("")).alias("names"))


def connected_files(edges: DataFrame, depth: int = 3, most: int = 150) -> DataFrame:
    """``(module, file, conn, rank)``: the best connected files of each module."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("file"), "weight")
    rows = ends.groupBy("file").agg(F.sum("weight").alias("conn")).withColumn("module", X.module_of(F.col("file"), depth))
    rank = F.row_number().over(W.partitionBy("module").orderBy(F.desc("conn"), "file"))
    return rows.select("module", "file", "conn", rank.alias("rank")).where(F.col("rank") <= most)


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%s</title></head><body><h1>%s</h1><table id="t"></table>
<script id="data" type="application/json">%s</script>
<script>const d=JSON.parse(document.getElementById("data").textContent),t=document.getElementById("t");
for(const e of d.module_edges){const r=t.insertRow();for(const k of ["src","dst","weight"])r.insertCell().textContent=e[k]}</script></body></html>"""


def html_page(modules: DataFrame, title: str, most: int = 5000) -> str:
    """One page with the ``most`` heaviest module edges, which says how many more there are; nothing in it can close the script."""
    rows = [r.asDict() for r in modules.orderBy(F.desc("weight"), "src", "dst").limit(most).collect()]
    left = modules.count() - len(rows) if len(rows) == most else 0
    title = f"{title} ({left} lighter edges are not shown)" if left else title
    safe = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
    return PAGE % (safe(title), safe(title), json.dumps({"module_edges": rows}).replace("<", "\\u003c"))
