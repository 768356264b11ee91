"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its ``NEAREST`` reference points in order of
similarity. Inverted lists are kept for pairs of pivots, so two vectors meet in
a list exactly when they share two or more of their nearest pivots; every pair
that meets is verified by its cosine in double precision, and counted only in
the list of its two least shared pivots. Reference points are a bounded sample
of the vectors (``MOST_PIVOTS`` at most); all vectors are indexed. Lists hold ids;
vectors are fetched for those that hold two or more. Lists of more than
``CHUNK`` vectors are verified chunk against chunk in different tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeway.llm.common import Scratch, connected_components, n_partitions

NEAREST, CHUNK = 6, 1024
#: Reference points: the square root of the vectors, so that lists stay short as vectors get more, within these bounds.
PIVOTS, MOST_PIVOTS = 256, 4096
#: Random reference points for a dimension that the sample misses.
SPARE = 32


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(sample: list[list[float]]) -> dict[int, np.ndarray]:
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    return {d: _unit(np.array(vs, np.float64)) for d, vs in by_dim.items()}


def _described(points: dict[int, np.ndarray]):
    """Adds the sorted nearest pivots of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            tops: list = [None] * len(vectors)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p = points.get(d)
                if p is None or len(p) < SPARE:
                    if d not in spare:
                        spare[d] = _unit(np.random.default_rng(d).standard_normal((SPARE, d)))
                    p = spare[d] if p is None else np.concatenate((p, spare[d]))
                near = _unit(np.array([vectors[i] for i in at], np.float64)) @ p.T
                best = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
                for i, row in zip(at.tolist(), np.sort(best, axis=1)):
                    tops[i] = row.astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.list_(pa.int32()))], [*batch.schema.names, "tops"])

    return run


def _shared_pair(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two least pivots that the sorted rows of ``a`` and ``b`` share."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    first = both.argmax(axis=1)
    rows = np.arange(len(a))
    both[rows, first] = False
    return a[rows, first], a[rows, both.argmax(axis=1)]


def _verified(least: float):
    """Link counts and spanning links of each inverted list, from rows sorted by list and side."""
    names = ["node", "partners", "root"]

    def group(key: tuple, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        x, tops, side, node, count = (rows[k] for k in ("x", "tops", "side", "node", "count"))
        n = int((side == 0).sum())
        if key[4] != key[5]:  # members of one chunk against those of another
            a, b = np.nonzero(x[:n] @ x[n:].T >= least)
            b = b + n
        else:
            a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        if len(a):
            p, q = _shared_pair(tops[a], tops[b])
            own = (p == key[2]) & (q == key[3])
            a, b = a[own], b[own]
        partners = np.bincount(a, count[b], len(side)) + np.bincount(b, count[a], len(side))
        root = np.arange(len(side))
        for i, j in zip(a.tolist(), b.tolist()) if len(a) < 2 * len(side) else _forest(a, b, len(side)):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            root[max(i, j)] = min(i, j)
        for i in range(len(root)):
            root[i] = root[root[i]]
        hit = partners > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(node[hit]), pa.array(partners[hit].astype(np.int64)), pa.array(node[root[hit]])], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None and sum(len(p["side"]) for p in parts) > 1:
                out = group(key, {k: np.concatenate([p[k] for p in parts]) for k in parts[0]})
                if out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("label_key", "dim", "p", "q", "i", "j")], axis=1)
            dims, vectors = keys[:, 1], batch.column("embedding")
            tops = np.array(batch.column("tops").flatten()).reshape(len(keys), -1)
            flat, ends = np.array(vectors.flatten(), np.float64), np.cumsum(dims)
            cols = {k: batch.column(k).to_numpy() for k in ("side", "node", "count")}
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                now = tuple(keys[s].tolist())
                if now != key:
                    yield from close()
                    key, parts = now, []
                x = flat[ends[s] - dims[s] : ends[e - 1]].reshape(e - s, -1)
                parts.append({"x": _unit(x), "tops": tops[s:e], **{k: v[s:e] for k, v in cols.items()}})
        yield from close()

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Links enough to connect what ``a`` and ``b`` link, by rounds of least neighbours."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return iter(zip(range(n), low.tolist()))
        low = new


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, least: float = 0.98, chunk: int = CHUNK
) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and dimension link at a cosine of ``least`` or more.
    Copies are counted as links of each other. Rows without vec_id, label or
    embedding, and vectors that are empty or zero or hold a null or a
    non-finite component, link with nothing and are their own component.
    Repeated rows come back repeated; other columns are ignored.
    """
    scratch = Scratch(spark, "pivots")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    inner = F.col("embedding")
    finite = F.forall(inner, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(inner, lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(inner) > 0) & finite, F.lit(False))
    rows = rows.withColumn("ok", ok).withColumn("vector_key", F.xxhash64("embedding"))
    good = rows.where("ok").groupBy("label", "vector_key", "embedding").agg(F.count("*").alias("count"), F.min("vec_id").alias("node"))
    good = scratch.save(good.withColumn("label_key", F.xxhash64("label")).withColumn("dim", F.size("embedding").cast("long")))
    sample = good.select("embedding", "vector_key").orderBy("vector_key").limit(max(PIVOTS, min(MOST_PIVOTS, math.isqrt(good.count())))).collect()
    points = _pivots([r["embedding"] for r in sample])
    described = scratch.save(
        good.mapInArrow(_described(points), T.StructType([*good.schema.fields, T.StructField("tops", T.ArrayType(T.IntegerType()))]))
    )

    pairs = [
        F.struct(F.get("tops", i).alias("p"), F.get("tops", j).alias("q")) for i, j in itertools.combinations(range(NEAREST), 2)
    ]
    lists = ["label_key", "dim", "p", "q"]
    ids = ["label_key", "dim", "vector_key", "node"]
    listed = described.select(*ids, F.inline(F.array(*pairs)))
    shared = listed.groupBy(*lists).agg(F.count("*").alias("m")).where("m > 1")
    listed = listed.join(shared.select(*lists, F.ceil(F.col("m") / chunk).cast("int").alias("chunks")), lists)
    own = F.pmod(F.shiftrightunsigned("vector_key", 7), F.col("chunks")).cast("int")
    listed = listed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    listed = listed.select(
        *ids, "p", "q", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    posted = listed.join(described.select(*ids, "count", "embedding", "tops"), ids)
    posted = posted.select(*lists, "i", "j", "side", "node", "count", "embedding", "tops")
    posted = posted.repartition(n_partitions(spark), *lists, "i", "j").sortWithinPartitions(*lists, "i", "j", "side")
    found = scratch.save(posted.mapInArrow(_verified(least), "node long, partners long, root long"))
    comp = connected_components(spark, found.where("node != root"), "node", "root")
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    nodes = good.select("label", "vector_key", "embedding", "count", "node").join(partners, "node", "left").join(comp, "node", "left")
    nodes = nodes.select(
        F.col("label").alias("l"), F.col("vector_key").alias("v"), F.col("embedding").alias("e"),
        (F.col("count") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
    )
    same = (F.col("ok")) & (F.col("label") == F.col("l")) & (F.col("vector_key") == F.col("v")) & (F.col("embedding") == F.col("e"))
    return rows.join(nodes, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
