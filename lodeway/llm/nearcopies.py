"""Near copies by the share of common word shingles, candidates by SimHash BK-trees and by MinHash.

Two texts are near copies if their sets of shingles have a Jaccard similarity
of ``least`` or more; every link is checked on the whole sets. Candidates are
the links of the SimHash BK-trees, and texts that agree in a band of minima of
random orders of their shingles: 64-bit fingerprints alone miss most pairs at
0.8. In a bucket of a band, texts are joined to candidate groups as far as
their minima make a similarity of ``least`` possible; sets are fetched for the
members of groups alone, once, and compared inside a group.

A group beyond the bounds of a task is first compared with some of its members
(its heads), in parts of bounded size; texts that these links leave outside the
largest component are then compared with all, part against part. So a group of
near copies costs a multiple of its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm import simhash
from lodeway.llm.common import Scratch, connected_components, n_partitions, possibly_in
from lodeway.llm.words import lowered_words_of, mixed

#: Bands of minima and minima of a band, each as its low 16 bits; a band is one long.
BANDS, ROWS = 16, 4
#: Equal minima below which a pair is no candidate: at a similarity of 0.8 so few come once in ten million pairs.
EQUAL = 33
#: Texts of a bucket beyond which all are joined to one without a look at their minima.
BUCKET = 4096
#: Texts and shingles that a part of a group holds, and heads of a group of several parts.
MEMBERS, SHINGLES, HEADS = 1024, 1 << 21, 32
_random = np.random.default_rng(5)
_FLIP, _FACTOR = _random.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTOR |= np.uint64(1)


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle; a shorter text is one, a null or empty one has the empty shingle."""
    words = lowered_words_of(text)
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, stops)), np.uint64, len(starts))


def fingerprint_of(h: np.ndarray) -> int:
    """``simhash.fingerprint`` of the text with these shingle hashes."""
    if len(h) == 1:
        return int(h[0])
    count, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(h), step):
        count += np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def bands(sets: np.ndarray) -> np.ndarray:
    """The minima of each band, 16 bits of each side by side."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 2048):
        low = np.minimum(low, ((sets[i : i + 2048] ^ _FLIP) * _FACTOR).min(axis=1))
    return mixed(low).astype(np.uint16).view(np.uint64)


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, text_key, key, fp, n, bands)``; ``key`` is a hash of the lower-cased words, ``n`` counts distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps, counts, lists = [], [], [], []
            for t in batch.column(2):
                text = t.as_py()
                keys.append(xxhash.xxh64_intdigest(b" ".join(lowered_words_of(text)), 7))
                h = hashes(text, shingle)
                distinct = np.unique(h)
                counts.append(len(distinct))
                lists.append(bands(distinct).view(np.int64))
                fps.append(fingerprint_of(h) if text and text.split() else 0)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), signed(keys), signed(fps), pa.array(counts, pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "key", "fp", "n", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, key long, fp long, n int, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(text_key, grams)`` of the texts whose text_key ``wanted`` holds and some more; a task tells each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, lists = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    lists.append(np.unique(hashes(text.as_py(), shingle)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["text_key", "grams"])

    rows = possibly_in(docs.select(F.xxhash64("text").alias("text_key"), "text"), "text_key", wanted.select("text_key"))
    return rows.where("_maybe").select("text_key", "text").mapInArrow(run, "text_key long, grams array<long>")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, pa.Array]]:
    """The columns of each run of rows alike in the columns ``names``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(keys[s].tolist())
            if now != last and held:
                yield _columns(held)
                held = []
            last = now
            held.append(batch.slice(s, e - s))
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return {c: table.column(c).combine_chunks() for c in table.column_names}


def _minima(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).view(np.uint16).reshape(-1, BANDS * ROWS)


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the texts of a bucket as far as their minima allow, from rows sorted by bucket."""
    for rows in _groups(batches, ["band", "value"]):
        minima, key = _minima(rows["bands"]), rows["key"].to_numpy()
        out, todo, rest = [], [], np.arange(len(key))
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            at = todo.pop()
            near = (minima[rest] == minima[at]).sum(axis=1) >= EQUAL
            todo += rest[near].tolist()
            out += [(int(key[at]), int(key[i])) for i in rest[near]]
            rest = rest[~near]
        yield _pairs(out)


def _checked(least: float):
    """Links that connect the near copies of every part; rows of side 0 are compared with all of their part."""

    def of(rows: dict[str, pa.Array]) -> list[tuple[int, int]]:
        keys, first = np.unique(rows["key"].to_numpy(), return_index=True)  # side 0 comes first
        if len(keys) < 2:
            return []
        order = np.sort(first)
        key, side, label = (rows[c].to_numpy()[order] for c in ("key", "side", "label"))
        minima, n = _minima(rows["bands"])[order], rows["n"].to_numpy()[order].astype(np.int64)
        offsets, flat = rows["grams"].offsets.to_numpy(), np.asarray(rows["grams"].values)
        sets = [flat[offsets[i] : offsets[i + 1]] for i in order.tolist()]
        _, root = np.unique(label, return_inverse=True)
        out, own = [], int((side == 0).sum())
        for i in range(own):
            near = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
            near = near[np.minimum(n[near], n[i]) >= least * np.maximum(n[near], n[i])]
            near = near[(minima[near] == minima[i]).sum(axis=1) >= EQUAL]
            for j in near.tolist():
                if root[i] == root[j]:
                    continue
                common = n[i] + n[j] - len(np.unique(np.concatenate((sets[i], sets[j]))))
                if common / (n[i] + n[j] - common) >= least:
                    out.append((int(key[i]), int(key[j])))
                    root[root == root[j]] = root[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["group", "i", "j"]):
            yield _pairs(of(rows))

    return run


def candidate_groups(spark: SparkSession, scratch: Scratch, nodes: DataFrame, radius: int) -> DataFrame:
    """``(key, group)`` of the texts that may be near copies of others."""
    members = nodes.select("key", F.posexplode("bands").alias("band", "value"))
    buckets = members.groupBy("band", "value").agg(F.count("*").alias("m"), F.min("key").alias("head")).where("m > 1")
    members = scratch.save(members.join(buckets, ["band", "value"]))
    small = members.where(F.col("m") <= BUCKET).join(nodes.select("key", "bands"), "key").select("band", "value", "key", "bands")
    small = small.repartition(n_partitions(spark), "band", "value").sortWithinPartitions("band", "value")
    found = small.mapInArrow(_candidates, "a long, b long")
    large = members.where((F.col("m") > BUCKET) & (F.col("key") != F.col("head"))).select(F.col("head").alias("a"), F.col("key").alias("b"))
    prints = scratch.save(nodes.groupBy("fp").agg(F.min("key").alias("node")))
    same = nodes.join(prints, "fp").where("key != node").select(F.col("node").alias("a"), F.col("key").alias("b"))
    near = simhash.links(spark, prints, prints.count(), radius)
    found = scratch.save(found.unionByName(large).unionByName(same).unionByName(near))
    scratch.drop(members)
    return connected_components(spark, found, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("group"))


def checked_links(spark: SparkSession, scratch: Scratch, held: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` that connect all near copies of ``held`` (group, parts, key, n, bands, grams)."""
    columns = ["group", "i", "j", "side", "label", "key", "n", "bands", "grams"]

    def links(rows: DataFrame) -> DataFrame:
        rows = rows.select(*columns).repartition(n_partitions(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j", "side")
        return scratch.save(rows.mapInArrow(_checked(least), "a long, b long"))

    plain = {"i": F.lit(0), "j": F.lit(0), "side": F.lit(0), "label": F.col("key")}
    found = links(held.where("parts = 1").withColumns(plain))
    large = held.where("parts > 1")
    if large.isEmpty():
        return found
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int")
    every = large.withColumns({**plain, "i": part, "side": F.lit(1)})
    least_key = large.groupBy("group").agg(F.min("key").alias("first"))
    heads = large.join(least_key, "group")
    heads = heads.where((F.col("key") == F.col("first")) | (F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts") * MEMBERS) < HEADS))
    heads = heads.withColumns({**plain, "i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    by_heads = links(heads.select(*columns).unionByName(every.select(*columns)))
    found = found.unionByName(by_heads)

    label = connected_components(spark, by_heads, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("label"))
    label = large.select("group", "key").join(label, "key", "left").select("group", "key", F.coalesce("label", "key").alias("label"))
    label = scratch.save(label)
    sizes = label.groupBy("group", "label").agg(F.count("*").alias("m"))
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("m"), F.max("m").alias("most"))
    main = main.where("m > most").select("group", "main", F.ceil((F.col("m") - F.col("most")) / MEMBERS).cast("int").alias("slices"))
    open_ = scratch.save(label.join(main, "group"))
    if open_.isEmpty():
        return found
    rest = large.join(open_.select("key", "label", "main", "slices"), "key")
    slice_ = F.pmod(F.xxhash64("key", F.lit(3)), F.col("slices")).cast("int")
    minor = rest.where("label != main").withColumns({"i": slice_, "j": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "side": F.lit(0)})
    all_ = rest.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "j": part, "side": F.lit(1)})
    return found.unionByName(links(minor.select(*columns).unionByName(all_.select(*columns))))


def near_copies(spark: SparkSession, docs: DataFrame, least: float = 0.8, shingle: int = 5, radius: int = 4) -> DataFrame:
    """``(doc_id, text_key, component_id, kept)`` for every row of ``docs`` (doc_id, text); rows need a doc_id.

    Words are as in ``simhash.near_duplicates``. The component is the smallest
    doc_id that checked links reach; each member but a single one is a near
    copy of some other member, not of all. ``kept`` marks the rows of the least
    doc_id and, of its texts, the least text_key (XXH64); rows alike in both
    are marked alike. Texts without words are copies of each other.
    """
    scratch = Scratch(spark, "nearcopies")
    rows = scratch.save(sketched(docs, shingle))
    nodes = rows.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = scratch.save(nodes.withColumn("text_key", F.col("first.text_key")))
    groups = scratch.save(candidate_groups(spark, scratch, nodes, radius))
    active = nodes.join(groups, "key").select("key", "group", "n", "bands", "text_key")
    sizes = active.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    sizes = sizes.select("group", F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("total") / SHINGLES)).cast("int").alias("parts"))
    active = scratch.save(active.join(sizes, "group"))
    held = scratch.save(active.join(shingle_sets(docs, active, shingle), "text_key").drop("text_key"))
    comp = connected_components(spark, checked_links(spark, scratch, held, least), "a", "b")
    scratch.drop(held)
    label = nodes.select("key", "first").join(comp.withColumnRenamed("node", "key"), "key", "left")
    label = label.select("key", "first", F.coalesce("component", "key").alias("component"))
    least_of = label.groupBy("component").agg(F.min("first").alias("least"))
    of_key = label.select("key", "component").join(least_of, "component").select("key", "least")
    kept = F.struct("doc_id", "text_key") == F.col("least")
    return rows.join(of_key, "key").select("doc_id", "text_key", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
