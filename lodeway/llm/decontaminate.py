"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``WINDOW`` consecutive words the ``GRAM``-word run of least hash is
the fingerprint (the leftmost of equal ones), so texts that share a window
share its fingerprint and its place in the window. Document fingerprints are
joined with those of the benchmark's windows; a hit is extended by comparing
the words around it with the window itself, so hash collisions never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import ascii_lower, let

WINDOW, GRAM = 13, 7
#: Grams in a window.
WIDTH = WINDOW - GRAM + 1
#: A packed fingerprint has the hash above and the position in the low bits.
POSITION_BITS = 28
#: Benchmark fingerprints up to which a set of them also filters within the row.
SET_LIMIT = 20_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII digits and letters and of other characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def _gram(ws: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` words from position ``at`` (0 first), below 2**35."""
    return F.shiftrightunsigned(F.xxhash64(F.slice(ws, at + 1, n)), 64 - 35)


def _upto(n: Column) -> Column:
    """0 .. n - 1, empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _packed(ws: Column, n: int = GRAM) -> Column:
    """Hash and position of every run of ``n`` words."""
    return F.transform(
        _upto(F.size(ws) - (n - 1)),
        lambda i: F.shiftleft(_gram(ws, i, n), POSITION_BITS).bitwiseOR(i.cast("long")),
    )


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1).cast("long")).cast("int")


def _least(grams: Column) -> Column:
    """The packed fingerprint of every window."""
    return F.transform(_upto(F.size(grams) - (WIDTH - 1)), lambda j: F.array_min(F.slice(grams, j + 1, WIDTH)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``(len, h, entries)``: the windows of each fingerprint with place, text and items.

    Items of fewer than ``WINDOW`` words, but not none, are one window, their
    own fingerprint. Items without id or words are left out.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
    items = items.where(F.size("ws") > 0).distinct()
    n = F.size("ws")
    long = let(
        F.col("ws"),
        lambda ws: F.transform(
            let(_packed(ws), _least),
            lambda p, s: F.struct(
                F.lit(WINDOW).alias("len"),
                _hash(p).alias("h"),
                (_position(p) - s).alias("offset"),
                F.array_join(F.slice(ws, s + 1, WINDOW), " ").alias("window"),
            ),
        ),
    )
    short = F.array(
        F.struct(
            n.alias("len"), F.shiftrightunsigned(F.xxhash64("ws"), 64 - 35).alias("h"), F.lit(0).alias("offset"),
            F.array_join("ws", " ").alias("window"),
        )
    )
    found = items.select("item", F.inline(F.when(n >= WINDOW, long).otherwise(short)))
    found = found.groupBy("len", "h", "offset", "window").agg(F.collect_set("item").alias("items"))
    return found.groupBy("len", "h").agg(F.collect_list(F.struct("offset", "window", "items")).alias("entries"))


def _hits(ws: Column, lengths: list[int], members: dict[int, list[int]] | None) -> Column:
    """Structs (len, h, p, context) of the document's fingerprints, the context WIDTH - 1 words before p and the window after."""

    def kept(packed: Column, n: int) -> Column:
        return F.filter(packed, lambda x: _hash(x).isin(members[n])) if members is not None else packed

    def told(packed: Column, n: int, before: int) -> Column:
        def one(x: Column) -> Column:
            first = F.greatest(_position(x) - before, F.lit(0))
            return F.struct(
                F.lit(n).alias("len"), _hash(x).alias("h"), _position(x).alias("p"),
                F.slice(ws, first + 1, _position(x) + n - first).alias("context"),
            )

        return F.transform(packed, one)

    def least(packed: Column, n: int) -> Column:
        """Fingerprints of all windows; none are looked for where no run of words is a fingerprint of the benchmark."""
        if members is None:
            return _least(packed)
        known = F.exists(packed, lambda x: _hash(x).isin(members[n]))
        return F.when(known, _least(packed)).otherwise(F.array().cast("array<long>"))

    parts = []
    for n in lengths:
        if n == WINDOW:
            parts.append(told(kept(F.array_distinct(let(_packed(ws), lambda g: least(g, WINDOW))), n), n, WIDTH - 1))
        else:
            parts.append(told(kept(_packed(ws, n), n), n, 0))
    return F.concat(*parts)


def contaminated() -> Column:
    """Whether hit words are a twentieth of the document's or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def benchmark_overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_words, n_hit, items)`` for every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a benchmark window, and
    ``items`` lists the ids, as sorted strings, of the items that have one.
    Null and empty texts have no words; repeated rows come back repeated; an
    empty benchmark hits nothing. Other columns are ignored.
    """
    windows = benchmark_windows(benchmark)
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.count("*").alias("n")).collect()}
    members = None
    if sum(sizes.values()) <= SET_LIMIT:  # else the join alone decides
        members = {n: [] for n in sizes}
        for r in windows.select("len", "h").collect():
            members[r["len"]].append(r["h"])
    own = F.struct(
        F.lit(0).alias("len"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("p"),
        F.array().cast("array<string>").alias("context"),
    )
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        let(
            words(F.col("text")),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.concat(F.array(own), _hits(ws, sorted(sizes), members)).alias("hits") if sizes else F.array(own).alias("hits"),
            ),
        ).alias("x"),
    )
    rows = rows.select("doc_id", "text_key", "x.n_words", F.inline("x.hits"))
    rows = rows.join(windows, ["len", "h"], "left")
    # A window starts at p - offset, and the context at p - min(p, WIDTH - 1), or at p for short items.
    before = F.when(F.col("len") == WINDOW, F.least("p", F.lit(WIDTH - 1))).otherwise(0)
    same = F.filter(
        "entries",
        lambda e: (e["offset"] <= before)
        & (F.array_join(F.slice("context", before - e["offset"] + 1, F.col("len")), " ") == e["window"]),
    )
    rows = rows.withColumn("same", same).where((F.col("len") == 0) | (F.size("same") > 0))
    rows = rows.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum((F.col("len") == 0).cast("int")).cast("int").alias("copies"),
        F.flatten(
            F.collect_list(
                F.transform("same", lambda e: F.struct((F.col("p") - e["offset"]).alias("s"), (F.col("p") - e["offset"] + F.col("len")).alias("e")))
            )
        ).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("same", lambda e: e["items"])))))).alias("items"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"].cast("long")))).alias("n"),
            F.greatest(a["end"], x["e"].cast("long")).alias("end"),
        ),
        lambda a: a["n"],
    )
    return rows.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
