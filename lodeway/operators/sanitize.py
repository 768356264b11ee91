"""Cleaning of extracted entities and relations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeway.functions import constants as K
from lodeway.functions import text as X


def looks_like_file(name: Column) -> Column:
    return F.lower(name).rlike("(?:" + "|".join(map(re.escape, K.FILE_SUFFIXES)) + ")$")


def entities(rows: DataFrame) -> DataFrame:
    """``(file, name, type, description, tags)`` of raw ``(file, name, type, description, tags)`` rows.

    Lengths are limited, aliases become types, an unknown label becomes
    ``symbol`` with the label as a tag, entities named like another file go, a
    file's own entity takes the file's type, and secret files lose texts.
    """
    name = X.one_spaced(F.col("name"), 160)
    label = F.lower(X.one_spaced(F.coalesce("type", F.lit("")), 40))
    kind = X.canonical_type(F.coalesce("type", F.lit("")))
    own = name == F.col("file")
    unknown = (kind == "symbol") & (label != "symbol") & (label != "") & ~own
    tags = X.sanitized_tags(F.concat_ws(",", F.coalesce("tags", F.lit("")), F.when(unknown, label)))
    text = F.when(X.is_secret(F.col("file")), "").otherwise(X.one_spaced(F.coalesce("description", F.lit("")), 300))
    out = rows.select("file", name.alias("name"), F.when(own & (kind == "module"), X.file_kind(F.col("file"))).otherwise(kind).alias("type"), text.alias("description"), tags.alias("tags"))
    out = out.where((F.col("name") != "") & ((F.col("name") == F.col("file")) | ~looks_like_file(F.col("name"))))
    return out.dropDuplicates(["file", "name", "type"])


def relations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Valid ``(file, from_name, relation, to_name)``: known types, an end among the ``known`` (file, name), no foreign definitions."""
    clean = rows.select("file", *(X.one_spaced(F.col(c), 160).alias(c) for c in ("from_name", "relation", "to_name")))
    clean = clean.where((F.col("from_name") != "") & (F.col("to_name") != "") & F.col("relation").isin(K.RELATION_TYPES))
    clean = clean.where(~((F.col("relation") == "defines") & looks_like_file(F.col("to_name")) & (F.col("to_name") != F.col("file"))))
    names = known.select("file", F.col("name")).union(clean.select("file", F.col("file"))).distinct()
    ends = clean.withColumn("name", F.explode(F.array("from_name", "to_name"))).join(names, ["file", "name"], "left_semi")
    return without_weaker(ends.drop("name").distinct())


def without_weaker(rows: DataFrame) -> DataFrame:
    """Distinct relations without a ``uses`` where the same pair has ``calls``, by one exchange; a pair with a null is like no other."""
    pair = ["file", "from_name", "to_name"]
    whole = F.col("file").isNotNull() & F.col("from_name").isNotNull() & F.col("to_name").isNotNull()
    found = rows.groupBy(pair).agg(F.collect_set("relation").alias("all"))
    kept = F.when(whole & F.array_contains("all", "calls"), F.array_remove("all", "uses")).otherwise(F.col("all"))
    return found.select(*pair, F.explode(kept).alias("relation")).select("file", "from_name", "relation", "to_name")
