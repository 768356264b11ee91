"""A counterfactual-regularised toxicity classifier.

Documents are described by which words and word beginnings they hold. A
logistic model is fitted on a bounded sample of labelled documents; for each of
them that names a group, the identity terms are swapped with those of other
groups, and the fit penalises the change of the score, so that a neutral
mention of a group does not move it. The model is a few thousand weights;
scoring is one pass over all texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.llm.common import Scratch

#: Labelled documents of each class that the fit takes at most, by least hash of doc_id.
FIT_ROWS = 4000
#: Size of the model: the features of most evidence that it keeps, and the least evidence (standard errors) for each. A
#: bound on what is learnt, not on what is read: evidence is counted over all words of all fit rows.
FEATURES, EVIDENCE = 4096, 4.0
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
#: Weight of the counterfactual penalty and of the squared weights.
PENALTY, RIDGE = 10.0, 1e-3

# Identity terms that stand in for each other, by kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("disabled", "blind", "deaf", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)
_SWAPS = {term: [t for t in terms if t != term] for terms in IDENTITY for term in terms}

_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    """The distinct words of the whole text, lower-cased."""
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    names = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)


def swapped(found: set[str]) -> set[str] | None:
    """The words with each identity term replaced by another of its kind; None without any."""
    terms = sorted(w for w in found if w in _SWAPS)
    if not terms:
        return None
    others = {_SWAPS[t][zlib.crc32(t.encode()) % len(_SWAPS[t])] for t in terms}
    return (found - set(terms)) | others


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, other = [], []
        for text in batch.column("text").to_pylist():
            found = words(text)
            swap = swapped(found)
            own.append(sorted({f for w in found for f in features_of(w)}))
            other.append(None if swap is None else sorted({f for w in swap for f in features_of(w)}))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own, kind), pa.array(other, kind)], ["label", "own", "other"])


class Model:
    """Weights of feature buckets and a bias; scores are logistic."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        active: set[int] = set()
        for w in words(text):
            kept = self.known.get(w)
            if kept is None:
                if len(self.known) > 1 << 19:
                    self.known.clear()
                self.known[w] = kept = tuple(f for f in features_of(w) if f in self.weights)
            if kept:
                active.update(kept)
        z = self.bias + sum(self.weights[f] for f in sorted(active))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit(labels: np.ndarray, own: list[np.ndarray], other: list[np.ndarray | None], rounds: int = 400) -> Model:
    """The model of documents given as arrays of the chosen features; ``other`` are the swapped ones."""
    n1, n = int(labels.sum()), len(labels)
    if not n1 or n1 == n:  # nothing to tell apart
        return Model({}, -2.0)
    n0 = n - n1
    chosen = np.unique(np.concatenate([*own, *(x for x in other if x is not None)]))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        return r, np.searchsorted(chosen, np.concatenate(rows)) if len(r) else np.zeros(0, np.int64)

    row, col = sparse(own)
    pair = [i for i, x in enumerate(other) if x is not None]
    row1, col1 = sparse([own[i] for i in pair])
    row2, col2 = sparse([other[i] for i in pair])
    w, bias = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.1
    y, weight = labels.astype(float), np.where(labels == 1, n / (2 * n1), n / (2 * n0))
    for t in range(1, rounds + 1):
        score = np.bincount(row, w[col], n) + bias
        gap = weight * (1 / (1 + np.exp(-score)) - y) / n
        grad = np.bincount(col, gap[row], len(w)) + RIDGE * w
        if pair:
            change = np.bincount(row1, w[col1], len(pair)) - np.bincount(row2, w[col2], len(pair))
            pull = 2 * PENALTY * change / n
            grad += np.bincount(col1, pull[row1], len(w)) - np.bincount(col2, pull[row2], len(w))
        g = np.concatenate((grad, [gap.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({int(f): float(x) for f, x in zip(chosen, w)}, float(bias))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Fit on at most ``FIT_ROWS`` documents of each class among the labels that ``usable`` admits.

    Rows of one doc_id count as toxic if one of their labels says so; labels
    other than 0 and 1 and rows without doc_id are ignored. Without usable
    labels of both classes, or documents for them, the model gives every text
    the same low score.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    rank = F.xxhash64(F.col("id").cast("string"), F.lit(3))
    parts = [known.where(F.col("label") == k).withColumn("rank", rank).orderBy("rank", "id").limit(FIT_ROWS) for k in (0, 1)]
    picked = [(r["id"], r["label"]) for part in parts for r in part.collect()]
    if not picked:
        return Model({}, -2.0)
    chosen = F.broadcast(spark.createDataFrame(picked, "id long, label int"))  # 2 * FIT_ROWS rows at most
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id").select("text", "label")
    rows = Scratch(spark, "toxicity").save(rows.mapInArrow(_described, "label int, own array<int>, other array<int>"))
    kept = evident(rows)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.array(kept, np.int32)
        cut = lambda x: None if x.as_py() is None else np.intersect1d(np.array(x.as_py(), np.int32), wanted)
        for batch in batches:
            kind = pa.list_(pa.int32())
            cols = [pa.array([cut(x) for x in batch.column(c)], kind) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], batch.schema.names)

    got = [(r["label"], r["own"], r["other"]) for r in rows.mapInArrow(narrowed, rows.schema).toLocalIterator()]
    array = lambda x: None if x is None else np.array(x, np.int32)
    # An order of their own, so that the sums of the fit do not hang on how rows came in.
    got.sort(key=lambda r: (r[0], r[1], r[2] or []))
    if not got:
        return Model({}, -2.0)
    return fit(np.array([r[0] for r in got]), [array(r[1]) for r in got], [array(r[2]) for r in got])


def evident(rows: DataFrame) -> list[int]:
    """At most ``FEATURES`` buckets of (label, own) rows whose shares differ most between the labels."""
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    counts = rows.select("label", F.explode("own").alias("f")).groupBy("f").agg(F.sum("label").alias("a"), F.count("*").alias("c"))
    counts = counts.where("c >= 2").crossJoin(F.broadcast(total)).where("n1 > 0 and n1 < n")
    p, n0 = F.col("c") / F.col("n"), F.col("n") - F.col("n1")
    gap = F.col("a") / F.col("n1") - (F.col("c") - F.col("a")) / n0
    z = F.abs(gap) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / F.col("n1") + 1 / n0))
    return [r["f"] for r in counts.select("f", z.alias("z")).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "f").limit(FEATURES).collect()]


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with its columns and ``toxicity`` (0 to 1), which replaces a column of that name.

    Null and empty texts get the bias alone. Repeated rows come back repeated
    with equal scores, an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return docs.withColumn("toxicity", score(F.col("text")))
