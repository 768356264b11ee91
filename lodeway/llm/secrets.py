"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds report every match. Weak kinds (an account name, an opaque token, an
endpoint) are reported only when their complementary parts stand within
``SCOPE`` code points in the same text. The parts are linked by an interval
join: every text is cut into buckets of ``SCOPE`` code points, each bucket keeps
the first and last start of each role, and a candidate meets its own bucket and
the two beside it; the nearest part of a role is always among those, so the
answer is exact and no list of pairs arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch, let

SCOPE = 400
#: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # a longer run is one match, a shorter one none
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "account": (r"(?i)(?<![a-z0-9_])(?:user(?:name)?|login|account|client_id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@+._-]{3,}", 0, 1),
    "opaque": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/_-])", 0, 32),
    "endpoint": (r"(?i)(?<![a-z0-9])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._:@/-]{4,}", 0, 1),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
#: Roles that must all stand in the scope of a weak candidate of the role.
NEEDS = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}
SPAN = "array<struct<s:int,k:int,e:int>>"
_BLOCK = 256


def _prefix_sums(lengths: Column) -> Column:
    """Sum of all lengths before each element, by blocks, so that long lists stay cheap."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    none = F.array().cast("array<int>")

    def inner(ls: Column) -> Column:
        n = F.size(ls)
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(ls, b * _BLOCK + 1, _BLOCK)))
        before = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), none.alias("all")),
            lambda a, b: F.struct((a["at"] + b).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")),
            lambda a: a["all"],
        )
        return let(
            before,
            lambda offs: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.get(offs, (i / _BLOCK).cast("int")) + total(F.slice(ls, (i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, inner)).otherwise(none)


def _spans(text: Column, kind: str) -> Column:
    """Start and end in code points of the matches of ``kind``, leftmost and not overlapping.

    The pieces between the matches and the matches themselves alternate, so
    their lengths add up to the positions.
    """
    pattern, group, least = {**BASE, **WEAK}[kind]
    regex, k = F.lit(pattern), F.lit(KINDS.index(kind))

    def found(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        lengths = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.char_length(h))
        return let(
            _prefix_sums(lengths),
            lambda before: F.filter(
                F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(before, i) + F.char_length(F.get(gaps, i))).alias("s"),
                        k.alias("k"),
                        (F.get(before, i) + F.char_length(F.get(gaps, i)) + F.char_length(h)).alias("e"),
                        F.char_length(F.get(x["counted"], i)).alias("n"),
                    ),
                ),
                lambda m: m["n"] >= least,
            ),
        )

    parts = F.struct(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("hits"),
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("counted"),
    )
    spans = F.transform(let(parts, found), lambda m: F.struct(m["s"].alias("s"), m["k"].alias("k"), m["e"].alias("e")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def scan(spark: SparkSession, docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, base, linked)`` for every row of ``docs``: arrays of spans (s, k, e).

    s and e are code points, e exclusive; k is the place of the kind in
    ``KINDS``. ``base`` has all base matches, ``linked`` the weak candidates
    with all complementary parts within ``scope`` and without overlap with a
    base match; both are sorted. Null and empty texts have none; repeated rows
    come back repeated. Other columns are ignored.
    """
    scratch = Scratch(spark, "secrets")
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(*(_spans(text, k) for k in BASE)))
    weak = F.concat(*(_spans(text, k) for k in WEAK))
    rows = scratch.save(docs.select("doc_id", F.xxhash64("text").alias("text_key"), base.alias("base"), weak.alias("weak")))
    clear = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    parts = (
        rows.where(F.size("weak") > 0).withColumn("weak", clear).where(F.size("weak") > 0)
        .dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", F.inline(F.concat("base", "weak")))
    )
    role = F.element_at(F.create_map(*(F.lit(x) for k, r in ROLE.items() for x in (KINDS.index(k), r))), F.col("k"))
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("s") / scope))
    near = parts.groupBy("doc_id", "text_key", "role", "bucket").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    weak_rows = parts.where(F.col("k") >= len(BASE))
    need = F.element_at(
        F.create_map(*(x for r, ns in NEEDS.items() for x in (F.lit(r), F.array(*map(F.lit, ns))))), F.col("role")
    )
    asks = weak_rows.withColumn("need", F.explode(need)).withColumn("at", F.explode(F.array(*(F.col("bucket") + d for d in (-1, 0, 1)))))
    near = near.select("doc_id", "text_key", F.col("role").alias("need"), F.col("bucket").alias("at"), "lo", "hi")
    close = (F.abs(F.col("lo") - F.col("s")) <= scope) | (F.abs(F.col("hi") - F.col("s")) <= scope)
    met = asks.alias("a").join(
        near.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t").withColumnRenamed("need", "n2").withColumnRenamed("at", "at2").alias("b"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("need") == F.col("n2")) & (F.col("at") == F.col("at2")) & close,
        "left_semi",
    )
    met = met.groupBy("doc_id", "text_key", "s", "k", "e", "role").agg(F.collect_set("need").alias("got"))
    full = F.element_at(F.create_map(*(F.lit(x) for r, ns in NEEDS.items() for x in (r, len(ns)))), F.col("role"))
    met = met.where(F.size("got") == full).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))
    met = met.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "linked")
    out = rows.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def told(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
