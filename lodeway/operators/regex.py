"""Regex and literal search over files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeway.functions import text as X
from lodeway.operators.extract import fixed_chunks


def safe_literals(pattern: str) -> list[str]:
    """Literals of three characters or more that every match holds; none where that is not sure."""
    if re.search(r"[|?*{\[(]|\\[^bBdDwWsS.]", pattern):
        return []
    plain = re.sub(r"\\.", " ", pattern)
    return [x for x in re.findall(r"[A-Za-z0-9_]{3,}", re.sub(r".\+", " ", plain))][:6]


def search(files: DataFrame, pattern: str, glob: str | None = None, ignore_case: bool = False, limit: int | None = 50) -> DataFrame:
    """``(file, line, match, context)`` of every match within blocks of 100 lines, found where it starts.

    Literals that every match must hold are looked for first. The line is
    counted from the text before the match, so matches may span lines.
    """
    if glob:
        files = files.where(F.col("file").rlike(X.glob_regex(glob)) if re.search(r"[*?\[]", glob) else F.col("file").contains(glob))
    rows = fixed_chunks(files)
    low = F.lower("text")
    for x in safe_literals(pattern):
        rows = rows.where(low.contains(x.lower()))
    regex = ("(?i)" if ignore_case else "") + pattern
    rows = rows.where(F.col("text").rlike(regex))
    hits, gaps = F.regexp_extract_all("text", F.lit(regex), F.lit(0)), F.split("text", regex, -1)
    rows = rows.select("file", "line_start", F.split("text", "\n", -1).alias("lines"), hits.alias("hits"), gaps.alias("gaps"))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    before = F.aggregate(
        F.sequence(F.lit(0), F.size("hits") - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, i: F.struct(
            (a["at"] + newlines(F.get("gaps", i)) + newlines(F.get("hits", i))).cast("int").alias("at"),
            F.concat(a["all"], F.array((a["at"] + newlines(F.get("gaps", i))).cast("int"))).alias("all"),
        ),
        lambda a: a["all"],
    )
    rows = rows.withColumn("before", before)
    rows = rows.select("file", "line_start", "lines", F.inline(F.arrays_zip("hits", "before")))
    rows = rows.where("hits != ''").select(
        "file", (F.col("line_start") + F.col("before")).alias("line"), F.substring("hits", 1, 200).alias("match"),
        F.substring(F.get("lines", F.col("before")), 1, 300).alias("context"),
    )
    return rows.orderBy("file", "line", "match").limit(limit) if limit else rows


def raw_occurrences(files: DataFrame, text: str, around: int = 2, limit: int | None = None) -> DataFrame:
    """``(file, line, context)`` of the lines that hold ``text`` in any case, with the lines around."""
    rows = files.where(F.lower("text").contains(text.lower())).select("file", X.lines(F.col("text")).alias("lines"))
    rows = rows.select("file", "lines", F.posexplode("lines").alias("pos", "line"))
    rows = rows.where(F.lower("line").contains(text.lower()))
    first = F.greatest(F.col("pos") + 1 - around, F.lit(1))
    context = X.stripped(F.array_join(F.slice("lines", first, F.col("pos") + 2 + around - first), "\n"))
    out = rows.select("file", (F.col("pos") + 1).alias("line"), context.alias("context"))
    return out.orderBy("file", "line").limit(limit) if limit else out


def structural(files: DataFrame, pattern: str, **options) -> DataFrame:
    """Search with ``$NAME`` standing for one argument. It reads characters, no syntax tree."""
    parts = re.split(r"(\$[A-Z_]+)", pattern)
    regex = "".join(r"[^,()]+?" if p.startswith("$") else r"\s*".join(map(re.escape, p.split(" "))) for p in parts)
    return search(files, regex, **options)
