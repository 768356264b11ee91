"""Entities and relations from stylesheets, configurations and templates, as one pass of expressions each.

All return ``(file, kind, name, type, pos)`` rows, kind being ``entity`` or a
relation type; ``pos`` orders first occurrences.
"""

from __future__ import annotations

import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeway.functions import constants as K
from lodeway.functions import text as X


# What the extraction of stylesheets, configurations and templates looks for, which defines its results.
BRACED, PROPERTY, IMPORTED = r"([^{}]+)\{", r"(--[A-Za-z0-9_-]+)\s*:", r"@import\s+(?:url\()?['\"]([^'\"]+)['\"]"
LOOSE_KEY = r"(?m)^[ \t]*[\"']?([A-Za-z0-9_.-]+)[\"']?\s*[:=]"
LAST_COMMA = r"(?s),((?:\s++|/\*.*?\*/|//[^\n]*+\n)*+[}\]])"
LENIENT = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNonNumericNumbers": "true", "allowNumericLeadingZeros": "true"}
TAG, CLASS, ID = r"<([A-Za-z][A-Za-z0-9:_-]*)", r"class(?:Name)?\s*=\s*[\"']([^\"']+)[\"']", r"id\s*=\s*[\"']([^\"']+)[\"']"
CALL, USE = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(", r"\b([a-zA-Z_][A-Za-z0-9_]*)\b(?!\s*\()"


def _found(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("pos", "name"))


def _distinct(rows: DataFrame) -> DataFrame:
    """First occurrence of each name of a file."""
    clean = rows.withColumn("name", X.one_spaced(F.col("name"), 160)).where("name != ''")
    return clean.groupBy("file", "name", "type").agg(F.min("pos").alias("pos"))


def stylesheet(files: DataFrame) -> DataFrame:
    """Selectors before braces, custom properties and imports: ``(file, name, type, relation, pos)``."""
    blocks = _found(files, BRACED).where(~F.startswith(F.trim(F.regexp_replace("name", r"^\s+", "")), F.lit("@")))
    selectors = blocks.select("file", "pos", F.explode(F.split("name", ",")).alias("name"), F.lit("selector").alias("type"))
    properties = _found(files, PROPERTY).withColumn("type", F.lit("variable"))
    imports = _found(files, IMPORTED).withColumn("type", F.lit("import"))
    rows = _distinct(reduce(DataFrame.unionByName, [selectors, properties, imports]))
    return rows.select("file", "name", "type", F.when(F.col("type") == "import", "imports").otherwise("defines").alias("relation"), "pos")


@F.pandas_udf(T.ArrayType(T.StringType()))
def toml_keys(texts: pd.Series) -> pd.Series:
    """Top-level keys of TOML texts; null where they do not parse."""

    def keys(text):
        try:
            return list(tomllib.loads(text))
        except (ValueError, TypeError):
            return None

    return texts.map(keys)


def config_keys(files: DataFrame) -> DataFrame:
    """Top-level keys of TOML and JSON files, else ``key:`` and ``key =`` at line starts: ``(file, name)``.

    JSON may have comments, bare keys, single quotes and trailing commas.
    """
    return _toml(files).unionByName(files.where(~_is_toml()).select("file", F.explode(_clean(_keys())).alias("name"))).distinct()


def _toml(files: DataFrame) -> DataFrame:
    """``config_keys`` of the TOML files alone, each name once a row."""
    rows = files.where(_is_toml()).select("file", F.coalesce(toml_keys("text"), _loose_keys()).alias("keys"))
    return rows.select("file", F.explode(_clean(F.col("keys"))).alias("name"))


def _clean(names: Column) -> Column:
    """Distinct names, white space runs as one space, 160 characters at most, none empty."""
    return F.array_remove(F.array_distinct(F.transform(names, lambda n: X.one_spaced(n, 160))), "")


def _is_toml() -> Column:
    return F.endswith(F.lower("file"), F.lit(".toml"))


def _loose_keys() -> Column:
    return F.regexp_extract_all("text", F.lit(LOOSE_KEY), F.lit(1))


def _keys() -> Column:
    """``config_keys`` of one row, TOML left out."""
    free = F.from_json(F.regexp_replace("text", LAST_COMMA, "$1"), "map<string,string>", LENIENT)
    parsed = F.when(F.rlike(F.lower("file"), F.lit(r"\.json5?\z")), F.coalesce(F.json_object_keys("text"), F.map_keys(free)))
    return F.coalesce(parsed, _loose_keys())


def template_tags(files: DataFrame) -> DataFrame:
    """``(file, name, type, relation, n)`` of the tags of templates; dashed and prefixed ones are used components."""
    rows = _found(files, TAG).groupBy("file", "name").agg(F.count("*").alias("n"))
    component = F.col("name").rlike("[-:]")
    return rows.select(
        "file", "name", F.when(component, "component").otherwise("template").alias("type"),
        F.when(component, "uses").otherwise("defines").alias("relation"), "n",
    )


def template_selectors(files: DataFrame) -> DataFrame:
    """``(file, name)`` of class and id selectors."""
    classes = _found(files, CLASS)
    classes = classes.select("file", F.explode(F.split(F.trim("name"), r"\s+")).alias("name")).where("name != ''")
    classes = classes.select("file", F.concat(F.lit("."), F.col("name")).alias("name"))
    ids = _found(files, ID).select("file", F.concat(F.lit("#"), F.col("name")).alias("name"))
    return classes.unionByName(ids).distinct()


# Where templates hold expressions.
EXPRESSIONS = [
    r"(?:\([\w.-]+\)|\[\(?[\w.()-]+\)?\]|\*[\w-]+)\s*=\s*[\"']([^\"']+)[\"']",
    r"\{\{([^}]+)\}\}",
    r"@(?:if|else\s+if|for|switch|case|defer|placeholder|loading|error|empty)\b[^{;]*?\(([^)]*)\)?",
    r"@let\s+\w+\s*=\s*([^;]+);",
]


def template_references(files: DataFrame) -> DataFrame:
    """``(file, relation, name)``: calls and uses in the bindings of templates; a call hides the use of its name."""
    scanned = reduce(DataFrame.unionByName, [_found(files, p) for p in EXPRESSIONS]).select("file", F.col("name").alias("text"))
    calls = _found(scanned, CALL).select("file", "name").distinct()
    uses = _found(scanned, USE).select("file", "name").distinct()
    calls = calls.where(~F.col("name").isin(K.TEMPLATE_LITERALS))
    uses = uses.where(~F.col("name").isin(K.TEMPLATE_LITERALS + K.TEMPLATE_LOCALS)).join(calls, ["file", "name"], "left_anti")
    return calls.select("file", F.lit("calls").alias("relation"), "name").unionByName(uses.select("file", F.lit("uses").alias("relation"), "name"))


def strategy(path: Column) -> Column:
    """Which extractor a file goes to."""
    kind = X.file_kind(path)
    return F.when(kind.isin("style", "config", "template"), kind).otherwise("model")


def _all(pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))


def _pieces(references: bool) -> Column:
    """What the rules find in one row's ``text``, by its ``kind``: an array of (type, relation, names); TOML left out.

    With ``references``, the calls and uses in templates too, their type null.
    """

    def piece(kind: str | None, relation: str, names: Column) -> Column:
        return F.struct(F.lit(kind).cast("string").alias("type"), F.lit(relation).alias("relation"), names.alias("names"))

    blocks = F.filter(_all(BRACED), lambda b: ~F.startswith(F.trim(F.regexp_replace(b, r"^\s+", "")), F.lit("@")))
    style = F.array(
        piece("selector", "defines", _clean(F.split(F.array_join(blocks, ","), ","))),
        piece("variable", "defines", _clean(_all(PROPERTY))), piece("import", "imports", _clean(_all(IMPORTED))),
    )
    config = F.array(piece("variable", "defines", _clean(_keys())))
    component = lambda n: n.rlike("[-:]")
    classes = F.array_remove(F.array_distinct(F.split(F.array_join(_all(CLASS), " "), r"\s+")), "")
    found = [
        piece("component", "uses", F.filter(_all(TAG), component)), piece("template", "defines", F.filter(_all(TAG), lambda n: ~component(n))),
        piece("selector", "defines", F.transform(classes, lambda n: F.concat(F.lit("."), n))),
        piece("selector", "defines", F.transform(_all(ID), lambda n: F.concat(F.lit("#"), n))),
    ]
    if references:
        bound = F.array_distinct(F.flatten(F.array(*map(_all, EXPRESSIONS))))
        inside = lambda pattern: F.flatten(F.transform(bound, lambda b: F.regexp_extract_all(b, F.lit(pattern), F.lit(1))))
        without = lambda names, words: F.array_except(names, F.array(*map(F.lit, words)))
        found += [piece(None, "calls", without(inside(CALL), K.TEMPLATE_LITERALS)), piece(None, "uses", without(inside(USE), K.TEMPLATE_LITERALS + K.TEMPLATE_LOCALS))]
    kind = F.col("kind")
    return F.when(kind == "style", style).when((kind == "config") & ~_is_toml(), config).when(kind == "template", F.array(*found))


def _structured(files: DataFrame, references: bool) -> DataFrame:
    """``(file, type, relation, name)`` by the rules, each row of ``files`` read once, and once more for TOML, which a function in Python parses."""
    rows = files.select("file", "text", strategy(F.col("file")).alias("kind")).select("file", F.inline(_pieces(references)))
    rows = rows.select("file", "type", "relation", F.explode("names").alias("name"))
    toml = _toml(files).select("file", F.lit("variable").alias("type"), F.lit("defines").alias("relation"), "name")
    return rows.unionByName(toml)


def structured(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entities, relations)`` of stylesheets, configurations and templates (file, text), each by its own rules.

    Entities are (file, name, type), relations (file, from_name, relation,
    to_name) start at the file. Other files have neither. Relations are dealt
    by file, so that what counts them by file exchanges nothing again.
    """
    entities = _structured(files, False).select("file", "name", "type").distinct()
    is_a = {r: F.bool_or(F.col("relation") == r) for r in ("defines", "imports", "calls", "uses")}
    found = _structured(files, True).repartition("file").groupBy("file", F.col("name").alias("to_name")).agg(*(v.alias(r) for r, v in is_a.items()))
    told = [F.when(F.col(r) & ~F.col("calls") if r == "uses" else F.col(r), F.lit(r)) for r in is_a]  # a call hides the use of its name
    relations = found.select("file", "to_name", F.explode(F.array_compact(F.array(*told))).alias("relation"))
    return entities, relations.select("file", F.col("file").alias("from_name"), "relation", "to_name")


def chunks(files: DataFrame, size: int = 60, overlap: int = 15, least: int = 60, whole: int = 10) -> DataFrame:
    """``(file, line_start, text)``: windows of lines; a file with none of ``least`` characters is one chunk of ``whole`` or more."""
    stride = size - overlap
    lines = X.lines(F.col("text"))

    def windows(ls: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(ls) - 1, F.lit(stride))
        cut = F.transform(
            starts,
            lambda i: F.struct(
                (i + 1).alias("line_start"), F.regexp_replace(F.array_join(F.slice(ls, i + 1, size), "\n"), r"\s+$", "").alias("text")
            ),
        )
        good = F.filter(cut, lambda w: F.length(F.regexp_replace(w["text"], r"^\s+", "")) >= least)
        whole_text = F.regexp_replace(F.array_join(ls, "\n"), r"\s+\z", "")
        one = F.when(
            F.length(F.regexp_replace(whole_text, r"^\s+|\s+$", "")) >= whole, F.array(F.struct(F.lit(1).alias("line_start"), whole_text.alias("text")))
        )
        return F.when(F.size(good) > 0, good).otherwise(one)

    return files.where("text is not null").select("file", F.inline(X.let(lines, windows)))


def fixed_chunks(files: DataFrame, size: int = 100) -> DataFrame:
    """``(file, line_start, text)``: blocks of ``size`` lines that are not blank."""
    cut = lambda ls: F.transform(
        F.sequence(F.lit(0), F.size(ls) - 1, F.lit(size)),
        lambda i: F.struct((i + 1).alias("line_start"), F.array_join(F.slice(ls, i + 1, size), "\n").alias("text")),
    )
    rows = files.where("text is not null").select("file", F.inline(X.let(X.lines(F.col("text")), cut)))
    return rows.where(F.col("text").rlike(r"\S"))


def locate(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, name, line_start, line_end, snippet)``: where entities stand in their file.

    The first line with a definition of the name or its leaf counts before one
    with ``leaf(``, where the name is dotted, and that before a bare mention;
    equal patterns take the first line. The place ends two lines further down.
    Each file's lines are read once for all of its names.
    """
    names = entities.select("file", "name").distinct().groupBy("file").agg(F.collect_list("name").alias("names"))
    rows = names.join(files.select("file", X.lines(F.col("text")).alias("lines")), "file")

    def place(name: Column) -> Column:
        last = X.leaf(name)
        leaf = F.when((last != "") & (last != name), last)
        words = [F.concat(F.lit(w + " "), n) for n in (name, leaf) for w in ("def", "class", "function", "const", "let", "var")]
        patterns = F.array_compact(F.array(*words, F.concat(leaf, F.lit("(")), name, leaf))
        at = F.transform(patterns, lambda p: F.array_position(F.transform("lines", lambda x: x.contains(p)), True))
        return F.struct(name.alias("name"), F.coalesce(F.get(F.filter(at, lambda i: i > 0), 0), F.lit(0)).cast("int").alias("at"))

    rows = rows.select("file", "lines", F.explode(F.transform("names", place)).alias("hit")).select("file", "hit.name", "hit.at", "lines")
    first = F.greatest(F.col("at") - 2, F.lit(1))
    end = F.least(F.size("lines"), F.col("at") + 2)
    piece = X.stripped(F.array_join(F.slice("lines", first, end + 1 - first), "\n"))
    found = F.col("at") > 0
    return rows.select(
        "file", "name", F.when(found, F.col("at")).alias("line_start"), F.when(found, end).alias("line_end"), F.when(found, piece).alias("snippet"),
    )
