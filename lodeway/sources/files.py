"""Source trees as DataFrames of files."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.functions import constants as K
from lodeway.functions import text as X
from lodeway.functions.paths import is_inside
from lodeway.sources.scratch import text_of


@dataclass
class ProjectConfig:
    """Settings of a project: more directories to ignore, more suffixes, and the size limit."""

    ignore_dirs: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    max_file_bytes: int = K.MAX_FILE_BYTES
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> ProjectConfig:
        """From a TOML file; defaults where it is missing or wrong."""
        try:
            data = tomllib.loads(Path(path).read_text("utf-8"))
            return cls(
                tuple(map(str, data.get("ignore", {}).get("dirs", ()))), tuple(map(str, data.get("extensions", {}).get("extra", ()))),
                int(data.get("graph", {}).get("max_file_bytes", K.MAX_FILE_BYTES)), data,
            )
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()


def ignored_by(patterns: str) -> list[tuple[bool, str]]:
    """``(ignore, regex)`` of the lines of a .gitignore, for project-relative paths; later ones decide."""
    out = []
    for line in patterns.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!").replace("\\ ", " ")
        below, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        body = ""
        for piece in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\])", line):
            fixed = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
            body += fixed[piece] if piece in fixed else piece.replace("[!", "[^") if piece[:1] == "[" else re.escape(piece)
        out.append((not keep, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if below else "(?:/.*)?$")))
    return out


def confined(spark: SparkSession, root: str) -> list[str]:
    """Paths below a local ``root`` that symbolic links take outside of it; other stores have none."""
    start = root.removeprefix("file://") if "://" not in root.removeprefix("file://") else ""
    if not start or not os.path.isdir(start):
        return []
    links = (os.path.join(d, n) for d, dirs, names in os.walk(start) for n in (*dirs, *names) if os.path.islink(os.path.join(d, n)))
    return sorted(os.path.relpath(p, start) for p in links if not is_inside(start, p))


def scan(spark: SparkSession, root: str, config: ProjectConfig | None = None, secrets: bool = False, search: bool = False) -> DataFrame:
    """``(file, mtime, length, text)`` of the indexable files below ``root``, in parallel.

    Paths are relative to ``root``. Ignored directories, what the project's
    .gitignore names, what links lead outside of it and, unless asked for,
    secret files are left out; invalid UTF-8 is dropped from the text.
    ``search`` takes the kinds of files and directories that code search
    takes, and sorts by path.
    """
    config = config or ProjectConfig()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    start = str(Path(root.removeprefix("file://")).resolve() if "://" not in root.removeprefix("file://") else root).rstrip("/")
    rows = raw.withColumn("file", F.substring(path, len(start) + 2, 1 << 20)).where(F.startswith(path, F.lit(start + "/")))
    if search:
        rows = rows.where(X.ends_with_any(F.col("file"), K.SEARCH_SUFFIXES) & ~X.ends_with_any(F.col("file"), K.SEARCH_DROPPED)).where(~X.is_below(F.col("file"), K.SEARCH_IGNORED)).orderBy("file")
    else:
        rows = rows.where(X.is_indexable(F.col("file"), config.extensions) & ~X.is_ignored(F.col("file"), config.ignore_dirs))
    ignored = F.lit(False)
    for ignore, regex in ignored_by(text_of(spark, f"{root}/.gitignore")):
        ignored = F.when(F.col("file").rlike(regex), F.lit(ignore)).otherwise(ignored)
    rows = rows.where(~ignored)
    for out in confined(spark, root):
        rows = rows.where((F.col("file") != out) & ~F.startswith("file", F.lit(out + "/")))
    rows = rows if secrets else rows.where(~X.is_secret(F.col("file")))
    text = F.regexp_replace(F.decode(F.try_validate_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8"), "�", "")
    loose = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    return rows.select("file", F.unix_micros("modificationTime").alias("mtime"), "length", F.coalesce(text, loose).alias("text"))


def indexable_content(files: DataFrame, config: ProjectConfig | None = None) -> DataFrame:
    """Files that are small enough to index and have some text."""
    most = (config or ProjectConfig()).max_file_bytes
    return files.where((F.octet_length("text") <= most) & (F.length(F.trim("text")) >= K.MIN_CHARS))


def reply_payload(reply: str) -> dict:
    """The JSON object in a model's reply, inside a code fence or not; comments and trailing commas may be in it. Else an empty one."""
    fenced = re.search(r"```[a-zA-Z0-9]*\s*\n(.*?)```", reply or "", re.S)
    body = (fenced.group(1) if fenced else reply or "").strip()
    outside = r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/'
    plain = re.sub(outside, lambda m: m.group(1) or "", body, flags=re.S)
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", plain, flags=re.S)
    for text in (body, plain):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        return got if isinstance(got, dict) else {}
    return {}


def prompted(complete: Callable[[str, str], str], most_chars: int = 100_000) -> Callable[[str, str], dict]:
    """An extractor that asks ``complete`` (file, code -> reply), which sees ``most_chars`` of a file."""
    return lambda file, text: reply_payload(complete(file, text[:most_chars]))


PAYLOAD = "struct<entities:array<struct<name:string,type:string,description:string,tags:string>>,relations:array<struct<from_name:string,relation:string,to_name:string>>>"


def extract_with(files: DataFrame, extractor: Callable[[str, str], dict] | None = None) -> DataFrame:
    """Payloads of a pluggable extractor, a call for each file; none gives empty payloads, a failing call too.

    Rows are pickled, a hundred at a time: batches of whole texts by the ten
    thousand, as Arrow has them, would fill a worker's memory.
    """

    def run(file: str, text: str) -> tuple[list[tuple], list[tuple]]:
        try:
            got = extractor(file, text) if extractor else {}
        except Exception:
            got = {}
        entities = [tuple(e.get(k) for k in ("name", "type", "description", "tags")) for e in got.get("entities", [])]
        return entities, [tuple(r.get(k) for k in ("from", "relation", "to")) for r in got.get("relations", [])]

    told = F.udf(run, PAYLOAD, useArrow=False).asNondeterministic()  # never called twice for a file
    return files.select("file", told("file", "text").alias("told")).select("file", "told.entities", "told.relations")
