"""What the operators share: scratch tables, text pieces, components.

Scratch tables are written as Parquet below the folder that the session names
in ``spark.checkpoint.dir``, which every executor shares; they cut lineage and
survive lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.sources.scratch import delete, shared_dir

#: ASCII white space, the only separators of ``[^\x20\x09-\x0D]+``.
SPACE = "[\\x20\\x09-\\x0D]+"


class Scratch:
    """Tables that one run of an operator writes and may drop again."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back: later reads never recompute it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of ``save`` that nothing reads any more."""
        delete(self.spark, df._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character unchanged."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as an unsigned long; 0 for null."""
    return F.coalesce(F.crc32(text), F.lit(0)).cast("long")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a key filter at most (16 MB), and bits for each of its keys below that.
FILTER_BITS, KEY_BITS = 1 << 27, 32
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15


def possibly_in(rows: DataFrame, key: str, keys: DataFrame, flag: str = "_maybe") -> DataFrame:
    """``rows`` with ``flag``: false only where the long column ``key`` is surely not among those of ``keys``.

    The filter is a hashed bitmap that executors build, of ``FILTER_BITS`` at
    most however many keys there are, so it can be broadcast: wide rows that it
    clears need no exchange, and an exact join decides on the others.
    """
    bits = min(FILTER_BITS, max(BITMAP, 1 << (KEY_BITS * keys.count() - 1).bit_length()))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = keys.select(cell(key).alias("_c")).groupBy(F.bitmap_bucket_number("_c").alias("_bucket"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_c")).alias("_bits"))
    rows = rows.withColumn("_c", cell(key)).withColumns({"_bucket": F.bitmap_bucket_number("_c"), "_at": F.bitmap_bit_position("_c")})
    rows = rows.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright("_at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (F.col("_at") % 8 + 1).cast("int"))) > 0
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_c", "_bucket", "_at", "_bits")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` of a saved table with ``name``: their number from 0 within each group of ``by``.

    Rows are numbered inside their partition and shifted by the group's rows in
    earlier ones, so that no group is gathered in one task.
    """
    rows = rows.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    inside = W.partitionBy(*by, "_pid").orderBy("_mid")
    rows = rows.withColumn("_in", F.row_number().over(inside))
    earlier = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_pid").agg(F.max("_in").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_pid").alias("_of_pid"), "_before")
    same = F.col("_pid") == F.col("_of_pid")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(counts, same).withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_pid", "_mid", "_in", "_before", "_of_pid", *(f"_of_{c}" for c in by))


def connected_components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of every node of the undirected ``edges``.

    The component is the smallest node id that can be reached. Alternating
    large-star and small-star rounds run as joins on the edge table, so that no
    node, link or component is gathered anywhere; hubs are pre-aggregated by
    the partial minimum, and their joins can be split. Every round is written
    to the shared folder, and its predecessor dropped. Rows with a null end
    are ignored; without edges the result is empty.
    """
    scratch = Scratch(spark, "components")
    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        new = scratch.save(small)
        scratch.drop(now)
        now = new
        row = now.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("u", "v")).alias("h"),
            F.sum(F.col("v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]
