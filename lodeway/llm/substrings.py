"""Exact removal of repeated word windows, behind a count-min prefilter.

Every window of ``window`` words is described by its minimizer, the run of
``GRAM`` words of least hash in it, which equal windows share. Partitions count
the documents of each minimizer in count-min sketches, which are merged slice
by slice; an estimate never falls below the true count of any window with that
minimizer. The second pass groups exactly only windows whose estimate is two or
more, so none is lost: first whole segments (neighbouring windows of one
minimizer), then, where different segments share a minimizer, their single
windows. The merged sketch becomes one bit a cell; its width follows the corpus
up to ``MAX_BITS``, which bounds what is broadcast. Beyond it more windows pass
the filter, and the exact grouping still decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch
from lodeway.llm.words import Rolling, WordHashes, mixed, words_of

#: Words of a minimizer.
GRAM = 20
#: Rows of the sketch.
DEPTH = 2
#: A slice has 2**SLICE_BITS cells; a row has 2**MIN_BITS to 2**MAX_BITS (64 MB as bits).
SLICE_BITS, MIN_BITS, MAX_BITS = 20, 20, 29


def _cells(m: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(m + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


class Segments:
    """The segments of texts: windows of one minimizer side by side."""

    def __init__(self, window: int) -> None:
        self.window, self.gram = window, min(GRAM, window)
        self.first, self.second = WordHashes(1), WordHashes(2)
        self.rolling = Rolling()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """First window, last window and minimizer hash of every segment."""
        n = len(words) - self.window + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none.view(np.uint64)
        self.p1 = self.rolling.prefix(self.first.of(words))
        grams = self.rolling.runs(self.p1, self.gram)
        width = self.window - self.gram + 1
        at = _leftmost_least(grams, width)
        cut = np.flatnonzero(np.diff(at)) + 1
        start = np.concatenate(([0], cut))
        end = np.concatenate((cut - 1, [n - 1]))
        return start, end, grams[at[start]]

    def windows(self, words: list[bytes]) -> np.ndarray:
        """A second, independent hash of every window; call after ``of``."""
        self.p2 = self.rolling.prefix(self.second.of(words))
        return self.rolling.runs(self.p2, self.window)


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in every run of ``width`` values."""
    at, have = np.arange(len(x)), 1
    while have < width:  # runs of twice the length from two of the present length
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at


def _sketch(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, held, size = Segments(window), [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            m = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            ids, ones, twos = [], [], []
            for row in range(DEPTH):
                cells, counts = np.unique(_cells(m, row, bits), return_counts=True)
                slices = cells >> SLICE_BITS
                cuts = np.flatnonzero(np.diff(slices)) + 1
                for c, k in zip(np.split(cells, cuts), np.split(counts, cuts)):
                    if len(c):
                        ids.append(int(c[0] >> SLICE_BITS) + (row << (bits - SLICE_BITS)))
                        low = (c & ((1 << SLICE_BITS) - 1)).astype(np.uint32)
                        ones.append(low[k == 1].tobytes())
                        twos.append(low[k > 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], ["slice", "ones", "twos"]
            )

        for batch in batches:
            for text in batch.column(0):
                m = np.unique(seg.of(words_of(text.as_py()))[2])  # once a document
                if len(m):
                    held.append(m)
                    size += len(m)
                if size > 1 << 20:
                    yield from emit()
                    size = 0
        yield from emit()

    return run


def _merged(key, rows) -> pa.Table:
    """The bits of one slice whose summed counts are two or more."""
    once, twice = (np.zeros(1 << SLICE_BITS, bool) for _ in range(2))
    for batch in rows:
        for ones, twos in zip(batch.column("ones"), batch.column("twos")):
            one = np.frombuffer(ones.as_py(), np.uint32)
            two = np.frombuffer(twos.as_py(), np.uint32)
            twice[one] |= once[one]
            once[one] = True
            twice[two] = once[two] = True
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})


def _repeated(window: int, bits: int, filled):
    """Segments whose estimated document count is two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segments(window)
        table = np.frombuffer(filled.value, np.uint8)
        names = ["doc_id", "text_key", "start", "m", "content", "hashes"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                start, end, m = seg.of(words)
                if not len(start):
                    continue
                keep = np.ones(len(m), bool)
                for row in range(DEPTH):
                    c = _cells(m, row, bits) + (row << bits)
                    keep &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                if not keep.any():
                    continue
                start, end, m = start[keep], end[keep], m[keep]
                hashes = seg.windows(words)
                # the content of a segment under both word hashes, as one 64-bit value beside m
                content = mixed(seg.rolling.spans(seg.p2, start, end + window)) ^ (end - start).astype(np.uint64)
                out[0] += [doc] * len(m)
                out[1] += [key] * len(m)
                out[2] += start.tolist()
                out[3] += m.view(np.int64).tolist()
                out[4] += content.view(np.int64).tolist()
                out[5] += [hashes[s : e + 1].view(np.int64) for s, e in zip(start, end)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    return run


def repeated_windows(spark: SparkSession, docs: DataFrame, window: int = 50, bits: int | None = None) -> DataFrame:
    """``(doc_id, text_key, starts, ends)`` of first windows to last, repeated from smaller doc_ids.

    ``text_key`` (XXH64 of the text) tells apart different texts under one doc_id.
    """
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    if bits is None:  # about 16 cells a segment
        n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, int(n_bytes).bit_length() - 3))
    partial = docs.select("text").mapInArrow(_sketch(window, bits), "slice int, ones binary, twos binary")
    merged = partial.groupBy("slice").applyInArrow(
        lambda key, rows: _merged(key, rows.to_batches()), "slice int, bits binary"
    )
    table = np.zeros(DEPTH << (bits - 3), np.uint8)
    for row in merged.toLocalIterator():  # DEPTH * 2**bits bits, at most 128 MB
        at = row["slice"] << (SLICE_BITS - 3)
        table[at : at + (1 << (SLICE_BITS - 3))] = np.frombuffer(row["bits"], np.uint8)
    filled = spark.sparkContext.broadcast(table.tobytes())

    segs = scratch.save(
        docs.mapInArrow(
            _repeated(window, bits, filled),
            "doc_id long, text_key long, start int, m long, content long, hashes array<long>",
        )
    )
    # Whole segments: each is repeated wherever a smaller doc_id holds the same content.
    held = scratch.save(
        segs.groupBy("m", "content").agg(F.min("doc_id").alias("first"), F.min_by("hashes", "doc_id").alias("hashes"))
    )
    whole = segs.select("doc_id", "text_key", "start", "m", "content", F.size("hashes").alias("n"))
    whole = whole.join(held.select("m", "content", "first"), ["m", "content"])
    gone = whole.where("doc_id > first").select("doc_id", "text_key", "start", (F.col("start") + F.col("n") - 1).alias("end"))
    gone = scratch.save(gone)  # a stage of its own, in which the rows of a segment that very many share can be split
    # Single windows, where different segments share a minimizer.
    several = held.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m")
    single = held.join(several, "m").select("m", "content", "first", F.posexplode("hashes").alias("i", "w"))
    single = scratch.save(single)
    least = single.groupBy("m", "w").agg(F.min("first").alias("least"))
    part = single.join(least, ["m", "w"]).where("least < first").select("m", "content", "first", "i")
    part = part.groupBy("m", "content", "first").agg(F.collect_list("i").alias("is"))
    part = whole.where("doc_id = first").select("m", "content", "doc_id", "text_key", "start").join(
        part.withColumnRenamed("first", "doc_id"), ["m", "content", "doc_id"]
    )
    part = part.select("doc_id", "text_key", "start", F.explode("is").alias("i"))
    part = part.select("doc_id", "text_key", (F.col("start") + F.col("i")).alias("start"))
    every = gone.unionByName(part.withColumn("end", F.col("start")))
    return every.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # rows alike tell the same


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if spans:
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, [s["start"] for s in spans], 1)
                    np.add.at(delta, [s["end"] + window for s in spans], -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    kept = words
                out[0].append(doc)
                out[1].append(len(words))
                out[2].append(len(words) - len(kept))
                out[3].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)

    return run


def _cut_digest(window: int):
    cut = _cut(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            digests = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def without_repeats(
    spark: SparkSession, docs: DataFrame, window: int = 50, digest: bool = False, bits: int | None = None
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``docs``; ``kept`` is the remaining text.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document of smaller doc_id; repeats within one document and
    texts of fewer words stay. Words are the runs between ASCII white space,
    joined by one space. Null and empty texts have no words; repeated rows are
    judged alike, and rows without doc_id are kept whole. ``digest`` gives
    ``kept_sha256`` instead of ``kept``. Other columns are ignored.
    """
    gone = repeated_windows(spark, docs.where("doc_id is not null"), window, bits)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    rows = docs.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    if digest:
        return rows.mapInArrow(_cut_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rows.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")
