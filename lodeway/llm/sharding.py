"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by key columns, and the shards are ranges of that order with
nearly equal bytes. Every round counts the exact bytes below a few candidate
boundaries of each open splitter, in one aggregation whose partitions send one
row each, and keeps the gap that holds the target; the least and greatest keys
around a candidate let it jump over empty ranges, and a key that alone covers
the target is cut by the next key column, rows that are all alike by their
number. When all splitters meet the tolerance, the rows are exchanged once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch, n_partitions, numbered, unsigned_crc32

#: Candidates of a splitter in a round.
PROBES = 7
#: Allowed error of a splitter as a share of a shard's bytes.
TOLERANCE = 0.0005
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """The range ``first`` to ``last`` of a key column, under fixed earlier columns, that holds the target."""

    target: int
    below: int  # bytes below the range
    above: int  # bytes below its end
    prefix: tuple[int, ...] = ()
    first: int = LOW
    last: int = HIGH
    found: tuple[int, ...] | None = None
    probes: list[int] = field(default_factory=list)

    def choose(self) -> None:
        width = self.last - self.first + 1
        steps = min(PROBES, width - 1)
        self.probes = sorted({self.first + width * i // (steps + 1) for i in range(1, steps + 1)} - {self.first})


def _less(keys: list[str], point: tuple[int, ...]) -> Column:
    """Whether the row's key lies below ``point``; missing columns count as least."""
    out = F.lit(False)
    for name, value in reversed(list(zip(keys, point))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def splitters(rows: DataFrame, keys: list[str], size: str, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Boundaries of the shards: shard i starts at the i-th one. ``keys`` are long columns without null.

    ``rows`` are units of ``_rows`` rows alike in all keys, ``size`` their bytes; a
    boundary inside a unit has the number of its rows below as a last place.
    """
    total = rows.agg(F.sum(size).alias("s")).first()["s"] or 0
    slack = tolerance * total / shards
    open_ = every = [Splitter(total * i // shards, 0, total) for i in range(1, shards)]
    while open_:
        wanted = []
        for n, s in enumerate(open_):
            s.choose()
            key = F.col(keys[len(s.prefix)])
            inside = F.lit(True)
            for name, value in zip(keys, s.prefix):
                inside = inside & (F.col(name) == value)
            for i, p in enumerate([*s.probes, None]):
                start = s.first if i == 0 else s.probes[i - 1]
                cell = inside & (key >= start) & (key <= s.last if p is None else key < p)
                wanted += [F.min(F.when(cell, key)).alias(f"lo{n}_{i}"), F.max(F.when(cell, key)).alias(f"hi{n}_{i}"), F.max(F.when(cell, F.col("_rows"))).alias(f"n{n}_{i}")]
                if p is not None:
                    wanted.append(F.sum(F.when(_less(keys, (*s.prefix, p)), F.col(size)).otherwise(0)).alias(f"b{n}_{i}"))
        got = rows.agg(*wanted).first()
        for n, s in enumerate(open_):
            below = [s.below, *((got[f"b{n}_{i}"] or 0) for i in range(len(s.probes))), s.above]
            starts = [s.first, *s.probes]
            at = next(i for i in range(len(starts)) if below[i] <= s.target <= below[i + 1])
            s.below, s.above = below[at], below[at + 1]
            lo, hi = got[f"lo{n}_{at}"], got[f"hi{n}_{at}"]
            if s.target - s.below <= slack:
                s.found = (*s.prefix, starts[at])
            elif s.above - s.target <= slack and hi is not None and hi < HIGH:
                s.found = (*s.prefix, hi + 1)
            elif lo < hi:
                s.first, s.last = lo, hi
            elif len(s.prefix) + 1 < len(keys):
                s.prefix, s.first, s.last = (*s.prefix, lo), LOW, HIGH
            else:  # a unit: its rows are counted out
                many = got[f"n{n}_{at}"]
                s.found = (*s.prefix, lo, round((s.target - s.below) * many / (s.above - s.below)))
        open_ = [s for s in open_ if s.found is None]
    return sorted(s.found for s in every)


@dataclass
class Parts:
    """Ranges of the shards' order that one task each can hold, and their rows."""

    hot: list[tuple[int, list[tuple[int, list[int]]]]]  # of a range: its keys of many rows, and where doc_id cuts each
    bits: int
    sliced: list[tuple[int, int, int]]  # units that are cut by number: both keys, and the rows of a slice

    def place(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """``rows`` with _cell, _side, _cut and _slice, which rise along the order of a shard."""
        rows = rows.withColumn("_cell", F.shiftright("_k", 64 - self.bits) if self.bits else F.lit(0).cast("long"))
        step = F.col("_step")
        rows = rows.withColumn("_slice", F.when(step.isNotNull(), F.floor(F.col("_n") / step)).otherwise(0).cast("long"))
        if not self.hot:
            return rows.withColumns({"_side": F.lit(0), "_cut": F.lit(0)})
        hot = spark.createDataFrame(self.hot, "_cell long, _hot array<struct<k: long, cuts: array<long>>>")
        rows = rows.join(F.broadcast(hot), "_cell", "left")
        own = F.filter("_hot", lambda h: h["k"] == F.col("_k"))
        side = 2 * F.size(F.filter("_hot", lambda h: h["k"] < F.col("_k"))) + F.size(own)
        before = lambda c: 2 * (c < F.col("_d")).cast("int") + (c == F.col("_d")).cast("int")
        cut = F.aggregate(F.flatten(F.transform(own, lambda h: h["cuts"])), F.lit(0), lambda a, c: a + before(c))
        known = F.col("_hot").isNotNull()
        rows = rows.withColumns({"_side": F.when(known, side).otherwise(0), "_cut": F.when(known, cut).otherwise(0)})
        return rows.drop("_hot")

    def stepped(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """``rows`` with _step, the rows of a slice of their unit; null for other units."""
        if not self.sliced:
            return rows.withColumn("_step", F.lit(None).cast("long"))
        return rows.join(F.broadcast(spark.createDataFrame(self.sliced, "_k long, _d long, _step long")), ["_k", "_d"], "left")


def parts(units: DataFrame, n: int, bounds: list[tuple[int, ...]]) -> Parts:
    """About ``n`` ranges of the keys of ``units`` (_k, _d, _size, _rows) of nearly equal bytes.

    The texts' hashes are even, so ranges of them are; a text so often repeated
    that it outweighs a range is cut by doc_id, and a unit that does, or holds one of
    the ``bounds``, by the number of its rows. No more than 2 n texts and units can.
    """
    bits = (n - 1).bit_length()
    cell = F.shiftright("_k", 64 - bits) if bits else F.lit(0).cast("long")
    sizes = {r["c"]: r["b"] for r in units.groupBy(cell.alias("c")).agg(F.sum("_size").alias("b")).collect()}
    mean = max(1, sum(sizes.values()) / (1 << bits))
    inside = F.lit(False)
    for b in bounds:
        if len(b) == 3:
            inside = inside | ((F.col("_k") == b[0]) & (F.col("_d") == b[1]))
    found = units.where((F.col("_rows") > 1) & ((F.col("_size") > mean) | inside)).collect()
    sliced = [(r["_k"], r["_d"], max(1, math.ceil(mean * r["_rows"] / r["_size"]))) for r in found]
    heavy = [c for c, b in sizes.items() if b > 2 * mean]
    if not heavy:
        return Parts([], bits, sliced)
    within = units.where(cell.isin(heavy)).groupBy("_k").agg(F.sum("_size").alias("b"), F.count("*").alias("n"))
    found = within.where((F.col("b") > mean) & (F.col("n") > 1)).collect()
    if not found:
        return Parts([], bits, sliced)
    own = {}
    for k, d, _ in sliced:
        own.setdefault(k, []).append(d)
    wanted = []
    for i, r in enumerate(found):
        steps = min(math.ceil(r["b"] / mean), r["n"])
        wanted.append(F.percentile_approx(F.when(F.col("_k") == r["_k"], F.col("_d")), [j / steps for j in range(1, steps)] or [0.0]).alias(f"q{i}"))
    got, by = units.where(F.col("_k").isin([r["_k"] for r in found])).agg(*wanted).first(), {}
    for i, r in enumerate(found):  # a sliced unit has a place of its own
        by.setdefault((r["_k"] >> (64 - bits)) if bits else 0, []).append((r["_k"], sorted({*got[i], *own.get(r["_k"], ())})))
    return Parts(list(by.items()), bits, sliced)


def sharded(spark: SparkSession, docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of ``docs`` with size, text_crc32, shard and slot.

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1), and the sizes of
    the shards are equal within ``tolerance`` and the largest single row. The
    order is by the text's XXH64 and doc_id (null first), so equal texts stand
    side by side; a group of them that lies across a boundary is cut between
    doc_ids, and rows alike in both by their number. ``slot`` counts the rows
    of a shard from 0 in that order, without gaps. ``docs`` is read twice and must give the same rows
    each time. Columns of those four names are replaced. An empty table gives
    an empty result.

    The ranges that tasks will hold and their rows are counted beforehand, from
    the keys alone. So whole rows are exchanged once and, but for rows that are cut by number, written
    nowhere else: a row's slot is its range's first one plus its place in the range.
    """
    scratch = Scratch(spark, "sharding")
    keys = ["_k", "_d"]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    keyed = [F.xxhash64("text").alias("_k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("_d"), size.alias("_size")]
    units = scratch.save(docs.select(*keyed).groupBy(*keys).agg(F.sum("_size").alias("_size"), F.count("*").alias("_rows")))
    bounds = [(*b, *(LOW, LOW, 0)[len(b) :]) for b in splitters(units, keys, "_size", shards, tolerance)]
    shard = F.lit(0)
    for b in bounds:
        shard = shard + (~_less([*keys, "_n"], b)).cast("int")
    cut = parts(units, n_partitions(spark), [b for b in bounds if b[-1]])
    at = ["shard", "_cell", "_side", "_cut", "_slice"]
    # The rows of a unit that is cut by number stand in pieces, between its slices and boundaries.
    pieces = cut.stepped(spark, units)
    ends = F.concat(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1, F.col("_step")), F.array(*(F.when((F.col("_k") == b[0]) & (F.col("_d") == b[1]), F.lit(b[2])).otherwise(0).cast("long") for b in bounds)))
    starts = F.when(F.col("_step").isNotNull(), F.array_sort(F.array_distinct(F.filter(ends, lambda x: x < F.col("_rows"))))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = pieces.withColumn("_starts", starts).select("*", F.posexplode("_starts").alias("_i", "_n"))
    pieces = pieces.withColumn("_many", F.coalesce(F.get("_starts", F.col("_i") + 1), F.col("_rows")) - F.col("_n"))
    counts = cut.place(spark, pieces.withColumn("shard", shard)).groupBy(*at).agg(F.sum("_many").alias("n")).collect()
    scratch.drop(units)
    starts, before = [], Counter()
    for i, r in enumerate(sorted(counts, key=lambda r: tuple(r[c] for c in at))):
        starts.append((*(r[c] for c in at), i, before[r["shard"]]))
        before[r["shard"]] += r["n"]
    known = spark.createDataFrame(starts, "shard int, _cell long, _side int, _cut int, _slice long, _part int, _start long")
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    rows = cut.stepped(spark, docs.select(F.struct(*kept).alias("_row"), *keyed))
    if cut.sliced:
        alike = numbered(scratch.save(rows.where("_step is not null")), keys, "_n")
        rows = rows.where("_step is null").withColumn("_n", F.lit(0)).unionByName(alike)
    else:
        rows = rows.withColumn("_n", F.lit(0))
    rows = cut.place(spark, rows.withColumn("shard", shard)).join(F.broadcast(known), at).drop(*at[1:], "_step")
    rows = rows.repartitionById(max(1, len(starts)), F.col("_part")).sortWithinPartitions(*keys, "_n")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select("_row.*", F.col("_size").alias("size"), unsigned_crc32(F.col("_row.text")).alias("text_crc32"), "shard", (F.col("_start") + place).alias("slot"))
