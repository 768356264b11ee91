"""SimHash near-duplicates: fingerprints linked through Hamming BK-trees.

Fingerprints are cut into blocks; two within ``radius`` bits agree on some
choice of blocks, so each such choice names a shard and no link is lost. A
shard's BK-tree hangs every fingerprint under its parent by the integer Hamming
distance, and a search follows only the edges within the radius. Shards reach
the tasks by the shuffle: one broadcast of all trees would grow with the
corpus. A shard of more than ``CHUNK`` fingerprints is cut into chunks, each
with its own tree, against which the members of the later chunks are searched,
so that no task holds an unbounded group and no pair is skipped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch, connected_components, n_partitions
from lodeway.llm.words import lowered_words_of

#: Members of one tree at most.
CHUNK = 4096
#: Mean members of a shard beyond which more blocks must agree.
SHARD = 256


class BKTree:
    """Fingerprints by Hamming distance: ``kids[i][d]`` is the child of i at distance d."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert ``value``; its place in ``values``."""
        self.values.append(value)
        self.kids.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            below = self.kids[at].setdefault(d, new)
            if below == new:
                break
            at = below
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all members at most ``radius`` bits from ``value``."""
        found, todo, values, kids = [], [0] if self.values else [], self.values, self.kids
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            low, high = d - radius, d + radius
            todo += [c for e, c in kids[at].items() if low <= e <= high]
        return found


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the word shingles, repeats included."""
    words = lowered_words_of(text)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    count, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(starts), step):  # a very long text needs no more memory
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[i : i + step], stops[i : i + step])), ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_keys(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks as (shift, width) lists; any two values within ``radius`` agree on one.

    Of ``radius + r`` blocks at least r agree. r grows until a shard of ``n``
    random fingerprints has few members.
    """
    for r in (1, 2, 3, 4):
        blocks = radius + r
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
        if n / 2 ** (64 * r // blocks) <= SHARD or r == 4:
            return [list(c) for c in itertools.combinations(parts, r)]
    raise AssertionError


def _links(radius: int):
    """Spanning links of every (shard, chunk) of rows sorted by them, tree members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, owner = None, BKTree(), []
        root: dict[int, int] = {}
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def close() -> None:
            out.extend((x, r) for x in list(root) if (r := find(x)) != x)
            root.clear()

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]
            for t, key, chunk, search, fp, node in zip(*(c.tolist() for c in cols)):
                if (t, key, chunk) != shard:
                    close()
                    shard, tree, owner = (t, key, chunk), BKTree(), []
                fp &= (1 << 64) - 1
                for at in tree.within(fp, radius):
                    a, b = find(owner[at]), find(node)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                if not search:
                    tree.add(fp)
                    owner.append(node)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def links(spark: SparkSession, nodes: DataFrame, n: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect all ``nodes`` (distinct fp, node) within ``radius`` bits."""
    choices = block_keys(n, radius)
    keys = []
    for t, parts in enumerate(choices):
        key = F.lit(0).cast("long")
        for shift, width in parts:
            piece = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(piece)
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = nodes.select("fp", "node", F.inline(F.array(*keys)))
    large = (
        rows.groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > chunk)
        .select("t", "key", F.ceil(F.col("m") / chunk).cast("int").alias("chunks"))
    )
    rows = rows.join(large, ["t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("own"))))
    rows = rows.select("t", "key", "chunk", (F.col("chunk") < F.col("own")).cast("int").alias("search"), "fp", "node")
    rows = rows.repartition(n_partitions(spark), "t", "key", "chunk").sortWithinPartitions("t", "key", "chunk", "search")
    return rows.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Lower-cases A-Z, takes words between ASCII white space and shingles of
    ``shingle`` words; a shorter text is one shingle, a null or empty one has
    fingerprint 0 and links like any other. Texts whose fingerprints differ in
    at most ``radius`` bits are linked; the component is the smallest doc_id
    that links reach. Repeated rows come back repeated, rows without doc_id
    with what others give their fingerprint. Other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, shingle))
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = links(spark, nodes, nodes.count(), radius)
    comp = connected_components(spark, found, "a", "b")
    classes = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
