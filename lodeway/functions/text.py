"""Column expressions over texts, names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeway.functions import constants as K


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


#: What ends a line of a file, whatever system wrote it.
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end starts no further one."""
    return F.split(F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), r"\n\z", ""), "\n", -1)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def tokens(text: Column) -> Column:
    """Index tokens: camel case and separators split, lower-cased, two characters or more.

    A text without any gives itself, trimmed and lower-cased, unless blank.
    """
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.lower(F.translate(spaced, "_/\\.-", " " * 5))
    found = F.regexp_extract_all(spaced, F.lit("[A-Za-zА-Яа-я0-9]{2,}"), F.lit(0))
    whole = F.lower(F.trim(text))
    rest = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))


def query_terms(query: str) -> list[str]:
    """``tokens`` of a query text, on the driver."""
    spaced = re.sub(r"[_/\\.\-]", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", query)).lower()
    found = [t for t in re.findall("[A-Za-zА-Яа-я0-9]+", spaced) if len(t) > 1]
    whole = query.strip(" ").lower()
    return found or ([whole] if whole else [])


def united_traits(detected: Column, tags: Column) -> Column:
    """Detected traits and a file's own tags as one sorted set, space-joined."""
    none = F.array().cast("array<string>")
    return F.concat_ws(" ", F.array_sort(F.array_union(F.coalesce(detected, none), F.coalesce(tags, none))))


def one_spaced(text: Column, limit: int) -> Column:
    """White space runs as one space, trimmed, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def leaf(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitized_tags(tags: Column) -> Column:
    """The first 8 tags, lower-cased, of [a-z0-9_-] and at most 24 characters, distinct in order."""
    parts = F.slice(F.filter(F.split(tags, r"[,\s]+"), lambda t: t != ""), 1, 8)
    clean = lambda t: F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9_-]+", "-"), "^-+|-+$", ""), 1, 24)
    return F.array_distinct(F.filter(F.transform(parts, clean), lambda t: t != ""))


def canonical_type(label: Column) -> Column:
    """The entity type of a label: itself, what it is an alias of, or ``symbol``."""
    low = F.lower(one_spaced(label, 40))
    alias = F.element_at(F.create_map(*(F.lit(x) for kv in K.TYPE_ALIASES.items() for x in kv)), low)
    return F.when(low.isin(K.ENTITY_TYPES), low).otherwise(F.coalesce(alias, F.lit("symbol")))


def _once(names: list[str]) -> list[str]:
    """Names in order, each in its first spelling."""
    out: dict[str, str] = {}
    for x in names:
        out.setdefault(x.lower(), x)
    return list(out.values())


# What is a compound identifier, a word of a name, and a piece of one. They define which literals and tokens a query has.
COMPOUND = r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+"
CAMEL = r"\b(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*)\b"
NAME_WORD = r"[A-Za-z0-9_]+"
NAME_PIECE = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+"


def query_literals(query: str) -> list[str]:
    """Compound identifiers of a query, first kebab, snake and dotted ones, then camel case; 4 characters or more."""
    found = re.findall(COMPOUND, query) + re.findall(CAMEL, query)
    return _once([x for x in found if len(x) >= 4])


def query_tokens(query: str) -> list[str]:
    """Words of a name query and their pieces, two characters or more, each once in any case."""
    out: list[str] = []
    for word in re.findall(NAME_WORD, query):
        pieces = [word, *(p for u in word.split("_") for p in (u, *re.findall(NAME_PIECE, u)))]
        out += [p for p in pieces if len(p) >= 2]
    return _once(out)


# paths


def is_secret(path: Column) -> Column:
    return F.lower(basename(path)).rlike("|".join(map(re.escape, K.SECRET_NAMES)))


def is_indexable(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether the file name ends with a known suffix, in any case."""
    return F.lower(basename(path)).rlike("(?:" + "|".join(re.escape(s.lower()) for s in (*K.CODE_SUFFIXES, *K.NAMED_FILES, *extra)) + ")$")


def ends_with_any(path: Column, suffixes: list[str]) -> Column:
    return F.lower(basename(path)).rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def is_below(path: Column, names: list[str]) -> Column:
    """Whether a directory of the path has one of ``names``, in any case."""
    dirs = F.transform(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.lower)
    return F.arrays_overlap(dirs, F.array(*(F.lit(n.lower()) for n in names)))


def is_ignored(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a directory of the project-relative path is one that is not indexed."""
    names = [*K.IGNORED_DIRS, *extra]
    dirs = F.transform(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.lower)
    plain = [n for n in names if "*" not in n]
    globbed = "|".join(glob_regex(n) for n in names if "*" in n)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, plain))) | F.exists(dirs, lambda d: d.rlike(globbed))


def glob_regex(glob: str) -> str:
    """A regex for a whole name; ``*`` crosses slashes."""
    out = ""
    for part in re.findall(r"\*|\?|\[[^\]]*\]|[^*?\[]+|\[", glob):
        out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(part) or (part.replace("[!", "[^") if len(part) > 2 and part[0] == "[" else re.escape(part))
    return f"^(?:{out})$"


def is_test_path(path: Column, globs=tuple(K.TEST_GLOBS)) -> Column:
    """By the globs of the coverage operator: ``**`` marks a part of the path, others fit path or name."""
    out = F.lit(False)
    for g in globs:
        if "**" in g:
            part = g.replace("**", "").strip("/")
            out = out | path.contains(part) if part else out
        else:
            out = out | path.rlike(glob_regex(g)) | basename(path).rlike(glob_regex(g))
    return out


def module_of(path: Column, depth: int = 3) -> Column:
    """The first ``depth`` directories, or ``<root>``."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n > 0, F.array_join(F.slice(parts, 1, n), "/")).otherwise(F.lit("<root>"))


def file_kind(path: Column) -> Column:
    """The entity type of a file's own entity."""
    name = F.lower(basename(path))
    suffix = F.when(F.substring(name, 2, 10_000).contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(name)
    return (
        F.when(name.startswith(".env") | name.endswith(".env"), "config")
        .when(suffix.isin(".css", ".scss", ".sass", ".less"), "style")
        .when(suffix.isin(".html", ".htm", ".vue", ".svelte", ".astro"), "template")
        .when(suffix.isin(".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env"), "config")
        .when(suffix.isin(".md", ".rst", ".txt", ".adoc"), "doc")
        .otherwise("module")
    )


def import_candidates(path: Column) -> Column:
    """Names by which a file may be imported."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    parts = F.split(bare, "/")
    dotted = F.array_join(parts, ".")
    n = F.size(parts)
    options = F.array(
        path, bare, F.concat(F.lit("./"), bare), F.concat(F.lit("./"), basename(bare)), dotted,
        F.when(F.startswith(dotted, F.lit("src.")), F.substring(dotted, 5, 10_000)),
        F.when(n > 2, F.array_join(F.slice(parts, 2, 10_000), ".")), F.when(n > 2, F.array_join(F.slice(parts, 3, 10_000), ".")),
    )
    return F.array_distinct(F.filter(options, lambda x: x.isNotNull() & (x != "")))


# traits


def language(path: Column) -> Column:
    name = F.lower(basename(path))
    suffix = F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    pairs = [F.lit(x) for lang, ends in K.LANGUAGES.items() for end in ends.split() for x in (end, lang)]
    return F.element_at(F.create_map(*pairs), suffix)


def traits(name: Column, snippet: Column, path: Column, kind: Column) -> Column:
    """Sorted traits of an entity from its snippet, name and path.

    Snippet, start of the snippet and language are computed once, and only the
    patterns of the one language are tried.
    """
    piece = F.trim(F.coalesce(snippet, F.lit("")))
    low = F.lower(path)
    given = F.struct(piece.alias("snip"), F.substring(piece, 1, 300).alias("start"), language(path).alias("lang"), low.alias("low"), basename(low).alias("base"), name.alias("name"), kind.alias("kind"))

    def found(x: Column) -> Column:
        snip, start, lang = x["snip"], x["start"], x["lang"]

        def hit(regexes: list[str]) -> Column:
            out = snip.rlike(regexes[0])
            for r in regexes[1:]:
                out = out | snip.rlike(r)
            cut = F.lit(False)  # a cut may end where the whole goes on
            for r in regexes:
                cut = cut | start.rlike(r)
            return out | ((F.length(snip) > 300) & cut)

        none = F.array().cast("array<string>")
        by_code = None
        for code, patterns in K.TRAITS.items():
            told = F.array(*(F.when(hit(regexes), F.lit(trait)) for trait, regexes in patterns.items()))
            by_code = F.when(lang == code, told) if by_code is None else by_code.when(lang == code, told)
        of_code = F.when(lang.isNotNull() & (snip != ""), by_code.otherwise(none)).otherwise(none)
        rest = [F.when(lang.isNotNull() & (snip != "") & snip.rlike(K.DEPRECATED), F.lit("deprecated"))]
        capital = F.substring(x["name"], 1, 1).rlike(r"^\p{Lu}")
        rest.append(F.when((lang == "go") & x["kind"].isin("function", "method", "class", "interface", "type") & capital, F.lit("exported")))
        own = (x["name"] != "") & ~F.startswith(x["name"], F.lit("_")) & x["kind"].isin("function", "method", "class")
        rest.append(F.when((lang == "python") & own, F.lit("exported")))
        rest.append(F.when(x["base"].rlike(K.TEST_BASENAME) | x["low"].rlike(K.TEST_FOLDER), F.lit("test")))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(of_code, F.array(*rest)))))

    return let(given, found)
