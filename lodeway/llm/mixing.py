"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold
their text, and source. A flow routes the words of the patterns to the quotas
of the sources; each further repetition of a text, and of a source's documents,
costs one more, so that repeats spread evenly. The network has a node for each
source and pattern, however rare. The flow of a pattern to a source becomes whole passes
over its documents and a seeded part of one more, which a histogram of seeded
hashes finds without sorting a source. What is decided about a class of
documents is one row, so documents are taken by a function of themselves and
that row, and their texts need not be moved.
"""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeway.llm.common import SPACE, Scratch, numbered, possibly_in

WEIGHTS = (1, 2, 3)
#: Passes over a document at most.
PASSES = 3
#: Repetitions of a text with a cost of their own.
TIERS = 8
#: Cells of the histogram of seeded hashes.
CELLS = 4096
#: Words that the last documents of a class, picked by their size, are to sum up to at most; more are left to the order of the hash.
FILL_WORDS = 1 << 16
#: Rows of classes up to which their decisions are broadcast.
BROADCAST_ROWS = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = PASSES) -> dict[str | None, float]:
    """Words that each source is to give: shares by weight, at most ``most`` times its size, the excess shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), order
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


class MinCostFlow:
    """Integer flow by primal-dual rounds: shortest paths, then blocking flows on them."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.cap[edge ^ 1]

    def run(self, s: int, t: int) -> None:
        """Rounds of least distance by prices, none of the costs given being negative; each fills all paths that short, fewest edges first."""
        price = [0] * len(self.out)
        while True:
            far = self._distances(s, t, price)
            if far[t] is None:
                return
            price = [p + (far[t] if d is None else min(d, far[t])) for p, d in zip(price, far)]
            while (level := self._levels(s, t, price))[t] is not None:
                nxt = [0] * len(self.out)
                while self._push(s, t, price, level, nxt):
                    pass

    def _distances(self, s: int, t: int, price: list[int]) -> list[int | None]:
        far: list[int | None] = [None] * len(self.out)
        far[s], todo = 0, [(0, s)]
        while todo:
            d, x = heappop(todo)
            if x == t:
                break
            if d > far[x]:
                continue
            for e in self.out[x]:
                if self.cap[e]:
                    y = self.to[e]
                    then = d + self.cost[e] + price[x] - price[y]
                    if far[y] is None or then < far[y]:
                        far[y] = then
                        heappush(todo, (then, y))
        return far

    def _levels(self, s: int, t: int, price: list[int]) -> list[int | None]:
        level: list[int | None] = [None] * len(self.out)
        level[s], todo = 0, deque([s])
        while todo and level[t] is None:
            x = todo.popleft()
            for e in self.out[x]:
                y = self.to[e]
                if self.cap[e] and level[y] is None and self.cost[e] + price[x] == price[y]:
                    level[y] = level[x] + 1
                    todo.append(y)
        return level

    def _push(self, s: int, t: int, price: list[int], level: list, nxt: list[int]) -> bool:
        path, x = [], s
        while x != t:
            edges = self.out[x]
            while nxt[x] < len(edges):
                e = edges[nxt[x]]
                y = self.to[e]
                if self.cap[e] and level[y] == level[x] + 1 and self.cost[e] + price[x] == price[y]:
                    break
                nxt[x] += 1
            if nxt[x] < len(edges):
                path.append(edges[nxt[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                return False
        room = min(self.cap[e] for e in path)
        for e in path:
            self.cap[e] -= room
            self.cap[e ^ 1] += room
        return True


def routed(own: dict[tuple[int, int], int], unique: dict[int, int], quotas: dict[int, int]) -> dict[tuple[int, int], int]:
    """Words that pattern p gives source s, from the sizes ``own`` of (p, s) and of the distinct texts of p."""
    ps, ss = {p: i for i, p in enumerate(sorted(unique))}, {s: i for i, s in enumerate(sorted(quotas))}
    net = MinCostFlow(len(ps) + len(ss) + 2)
    source, sink = len(ps) + len(ss), len(ps) + len(ss) + 1
    room: dict[int, int] = {}
    for (p, _), size in own.items():
        room[p] = room.get(p, 0) + PASSES * size
    for p, i in ps.items():
        left = room.get(p, 0)
        for tier in range(TIERS):
            cap = left if tier == TIERS - 1 else min(left, unique[p])
            if cap > 0:
                net.add(source, i, cap, tier)
                left -= cap
    edges: dict[tuple[int, int], list[int]] = {}
    for (p, s), size in sorted(own.items()):
        if size:
            edges[p, s] = [net.add(ps[p], len(ps) + ss[s], size, tier) for tier in range(PASSES)]
    for s, i in ss.items():
        net.add(len(ps) + i, sink, quotas[s], 0)
    net.run(source, sink)
    return {k: sum(map(net.flow, es)) for k, es in edges.items()}


ID = ["doc_id", "text_key"]


def _fill(left: int, items: list[tuple]) -> list[tuple]:
    """Of ``items`` (size, ...) some whose sizes sum up as near to ``left`` as they can, exactly, by a table of reachable sums."""
    most = min(left, FILL_WORDS) * 2
    reach, before = 1, []
    for size, *_ in items:
        before.append(reach)
        if size <= most:
            reach |= reach << size
    reach &= (1 << most + 1) - 1
    sums = [x for d in range(left + 1) for x in ((left - d, left + d) if d else (left,)) if 0 <= x <= most and reach >> x & 1][:1]
    at, out = sums[0] if sums else 0, []
    for item, old in zip(reversed(items), reversed(before)):
        if not old >> at & 1:
            at -= item[0]
            out.append(item)
    return out


def _decided(spark: SparkSession, scratch: Scratch, units: DataFrame, given: dict, own: dict) -> DataFrame:
    """One row a class (p, s): ``passes`` over all its documents, and which get one more.

    These are those below the cell ``last`` of the seeded hash, within that
    cell those up to ``cut`` in the order of the hash, and the ``fills``;
    of the rows that are all alike ``part``, ``some`` get one. ``units`` are
    the documents with their number of rows ``n``.
    """
    classes = "p int, s int, passes int, part long"
    decided = [(*k, min(PASSES, f // own[k]), f - own[k] * min(PASSES, f // own[k])) for k, f in sorted(given.items()) if own[k]]
    few = len(decided) <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    plan = spark.createDataFrame(decided, classes)
    words = F.col("size") * F.col("n")
    cells = units.groupBy("p", "s", "cell").agg(F.sum(words).alias("words"))
    upto = F.sum("words").over(W.partitionBy("p", "s").orderBy("cell"))  # CELLS rows a class at most
    ends = cells.withColumn("upto", upto).join(near(plan), ["p", "s"]).where("upto > part and upto - words <= part")
    ends = scratch.save(ends.select("p", "s", "passes", F.col("cell").alias("last"), (F.col("part") - F.col("upto") + F.col("words")).alias("rest")))
    edge = units.join(near(ends), ["p", "s"]).where("cell = last")
    order = W.partitionBy("p", "s").orderBy("rank", *ID).rowsBetween(W.unboundedPreceding, 0)
    edge = scratch.save(edge.select("p", "s", "rank", *ID, "size", "n", "rest", F.sum(words).over(order).alias("sum")))
    place = F.struct("rank", *ID)
    fits = F.col("sum") <= F.col("rest")
    cuts = edge.groupBy("p", "s").agg(
        F.max(F.when(fits, place)).alias("cut"), F.max(F.when(fits, F.col("sum")).otherwise(0)).alias("got"),
        F.min(F.when(~fits, F.struct("sum", "rank", *ID, "size", "n"))).alias("next"),
    )
    # Of the first document that does not fit, as many of its equal rows as do.
    some = F.floor((F.col("rest") - F.col("got")) / F.col("next.size"))
    ends = ends.join(near(cuts), ["p", "s"])
    ends = ends.withColumns({"some": F.coalesce(F.when(F.col("next.n") > 1, some), F.lit(0)).cast("int")})
    ends = ends.withColumns({"part": F.when(F.col("some") > 0, F.struct("next.doc_id", "next.text_key")), "lack": F.col("rest") - F.col("got") - F.coalesce(F.col("some") * F.col("next.size"), F.lit(0))})
    ends = scratch.save(ends.select("p", "s", "passes", "last", "cut", "part", "some", "lack"))

    # Two documents of each size class, of what is still free, to fill what lacks.
    free = units.join(near(ends.where("lack > 0")), ["p", "s"]).where(~_more(F.col("cell"), place) & (F.col("size") > 0) & (F.col("n") == 1))
    free = free.where("size < 2 * lack")
    found = free.groupBy("p", "s", F.floor(F.log2("size") * 4).alias("class")).agg(
        F.min(F.struct("rank", "size", *ID)).alias("a"), F.max(F.struct("rank", "size", *ID)).alias("b"), F.first("lack").alias("lack")
    )
    picked: dict[tuple, tuple[int, set]] = {}
    for r in found.toLocalIterator():  # about a hundred rows a class at most
        picked.setdefault((r["p"], r["s"]), (r["lack"], set()))[1].update((x["size"], x["doc_id"], x["text_key"]) for x in (r["a"], r["b"]))
    rows = [(*k, [(d, t) for _, d, t in _fill(lack, sorted(items, key=repr))]) for k, (lack, items) in sorted(picked.items())]
    fills = spark.createDataFrame(rows, "p int, s int, fills array<struct<doc_id:long,text_key:long>>")
    return scratch.save(ends.drop("lack").join(near(fills), ["p", "s"], "left"))


def _more(cell, place):
    """Whether a document of a class gets one more pass by its hash."""
    return (cell < F.col("last")) | (cell == F.col("last")) & F.coalesce(place <= F.col("cut"), F.lit(False))


class Mix:
    """What is decided about all documents: sources, shared texts, and a row for each class."""

    def __init__(self, scratch: Scratch, seed: int, names: DataFrame, shared: DataFrame, classes: DataFrame, few: bool) -> None:
        self.scratch, self.seed, self.names, self.shared, self.classes, self.few = scratch, seed, names, shared, classes, few

    def taken(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, text_key, source, ...) with source_size, target and ``times``, how often each is taken.

        Rows move only if their text may be one that several sources share, or
        if some but not all of several equal rows are taken.
        """
        near = F.broadcast if self.few else lambda df: df
        same = F.col("source").eqNullSafe(F.col("name"))
        rows = rows.join(near(self.names.withColumnRenamed("source", "name")), same).drop("name")
        rows = possibly_in(rows, "text_key", self.shared.select("text_key"))
        own = rows.where("not _maybe").withColumn("p", F.col("s"))
        both = rows.where("_maybe").join(self.shared, "text_key", "left").withColumn("p", F.coalesce("p", "s"))
        cell, rank = _seeded(self.seed)
        rows = own.unionByName(both).join(near(self.classes), ["p", "s"], "left")
        more = _more(cell, F.struct(rank.alias("rank"), *ID)) | F.exists("fills", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id")) & (x["text_key"] == F.col("text_key")))
        split = F.coalesce(F.col("part.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("part.text_key") == F.col("text_key")), F.lit(False))
        rows = rows.withColumns({"_split": split, "_more": F.coalesce(more, F.lit(False))})
        out = rows.where("not _split")
        if not self.classes.where("some > 0").isEmpty():
            alike = self.scratch.save(rows.where("_split"))
            alike = numbered(alike, ["p", "s"], "_nth").withColumn("_more", F.col("_nth") < F.col("some")).drop("_nth")
            out = out.unionByName(alike)
        times = F.least(F.coalesce("passes", F.lit(0)) + F.col("_more").cast("int"), F.lit(PASSES))
        return out.withColumn("times", times).drop("p", "s", "_maybe", "passes", "last", "cut", "part", "some", "fills", "_split", "_more")


def _seeded(seed: int):
    """Cell and rank of a document."""
    cell = F.pmod(F.xxhash64(F.lit(seed), *ID), F.lit(CELLS)).cast("int")
    return cell, F.xxhash64(F.lit(seed + 1), *ID)


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, source, size)``, the size in words."""
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE, -1), "")).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "source", n_words.alias("size"))


def planned(spark: SparkSession, rows: DataFrame, seed: int = 0) -> Mix:
    """The mix of the documents ``rows`` (as ``measured`` gives them, saved)."""
    scratch = Scratch(spark, "mixing")
    sizes = {r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(sizes)
    number = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    names = spark.createDataFrame([(s, i, sizes[s], goal[s]) for s, i in number.items()], "source string, s int, source_size long, target double")
    few = len(number) <= BROADCAST_ROWS
    numbers = names.select(F.col("source").alias("name"), "s")
    rows = rows.join(F.broadcast(numbers) if few else numbers, F.col("source").eqNullSafe(F.col("name")))
    units = scratch.save(rows.groupBy("s", *ID).agg(F.first("size").alias("size"), F.count("*").alias("n")))

    # Patterns: texts of one source stay under its own number, from 0; shared sets get numbers above.
    texts = units.groupBy("text_key").agg(F.array_sort(F.collect_set("s")).alias("sources"), F.max("size").alias("once")).where(F.size("sources") > 1)
    texts = scratch.save(texts)
    common = texts.groupBy("sources").agg(F.sum("once").alias("once"), F.count("*").alias("n")).orderBy(F.desc("n"), "sources").collect()
    base = len(number)
    known = {tuple(r["sources"]): base + i for i, r in enumerate(common)}
    listed = spark.createDataFrame([(list(k), v) for k, v in known.items()], "sources array<int>, p int")
    shared = scratch.save(texts.join(F.broadcast(listed) if len(known) <= BROADCAST_ROWS else listed, "sources").select("text_key", "p"))
    cell, rank = _seeded(seed)
    units = units.join(shared, "text_key", "left").withColumns({"p": F.coalesce("p", "s"), "cell": cell, "rank": rank})
    units = scratch.save(units)
    own = {(r["p"], r["s"]): r["words"] for r in units.groupBy("p", "s").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    once = {p: 0 for p, _ in own}
    for (p, _), size in own.items():
        if p < base:
            once[p] += size
    once |= {known[tuple(r["sources"])]: r["once"] for r in common}
    given = routed(own, once, {i: round(goal[s]) for s, i in number.items()})

    # Texts of several sources first; a source's own texts make up for what whole documents missed.
    classes = _decided(spark, scratch, units.where(F.col("p") >= base), {k: f for k, f in given.items() if k[0] >= base}, own)
    missed = {s: goal[name] for name, s in number.items()}
    if common:
        mix = Mix(scratch, seed, names, shared, classes, few)
        some = rows.join(shared.select("text_key"), "text_key", "left_semi").select("doc_id", "text_key", "source", "size")
        got = mix.taken(scratch.save(some)).groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("got"))
        for r in got.collect():
            missed[number[r["source"]]] -= r["got"]
    rest = {(s, s): max(0, min(PASSES * own[s, s], round(missed[s]))) for s in number.values() if (s, s) in own}
    classes = classes.unionByName(_decided(spark, scratch, units.where(F.col("p") < base), rest, own))
    return Mix(scratch, seed, names, shared, scratch.save(classes), few and len(given) <= BROADCAST_ROWS)


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 0) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, taken, times)`` for every row of ``docs``.

    ``size`` counts the words between ASCII white space (null text: 0),
    ``taken`` is ``times`` it, at most ``PASSES`` times. The sources, in
    code point order and null last, weigh 1, 2, 3, repeating. A source's taken
    words miss its target by less than its smallest document that is not taken
    fully, and by far less where it has documents of many sizes. The choice depends
    on ``seed``, doc_id and text alone; rows alike in both may be taken
    differently, their number not. Sources and patterns are held on the driver, one row
    each. An empty table gives an empty result; other columns are ignored.
    """
    rows = Scratch(spark, "mixing").save(measured(docs))
    out = planned(spark, rows, seed).taken(rows)
    taken = (F.col("size") * F.col("times")).cast("long")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"), "times")
