import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodeway.llm import mixing, nearcopies, simhash
from tests.llm import brute, data

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(600)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(r.randint(60, 140)), f"s{i % 3}") for i in range(120)]
    toxic = {i for i in range(0, 120, 5)}
    docs = [(i, t + " gromp blafnik" if i in toxic else t, s) for i, t, s in docs]
    bench = [(1, prose(30)), (2, prose(20))]
    docs += [(200 + i, docs[i][1], "s1") for i in range(1, 30, 4)]  # exact copies
    docs += [(300 + i, docs[i][1].replace(docs[i][1].split()[20], "altered", 1), "s2") for i in range(2, 30, 4)]  # near copies
    docs += [(400 + i, prose(20) + " " + bench[i % 2][1] + " " + prose(20), "s0") for i in range(4)]
    docs += [(500, None, "s0"), (501, "", None), (None, prose(50), "s1"), docs[7], docs[7]]
    labels = [(i, 1, int(i in toxic)) for i in range(120)]
    return docs, labels, bench, toxic


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, bench, toxic = corpus()
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in docs], COLUMNS)
    folder = data.write(
        spark, tmp_path, documents=frame, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame(bench, "item_id long, text string"),
    )
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
        out = stage(spark, now, folder)
        assert name == "sharding" or out.columns == now.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        after = [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]
        kept[name] = (before, after)
    gone = lambda name: {d for d, _, _ in kept[name][0]} - {d for d, _, _ in kept[name][1]}
    copies_of_toxic = {d for d, t, _ in docs if t and "gromp" in t}
    assert gone("toxicity") == copies_of_toxic

    before, after = kept["simhash_near_dedup"]
    assert len(after) == len({d for d, _, _ in after}) and any(d is None for d, _, _ in after)
    words = {d: brute.WORD.findall(t or "") for d, t, _ in before}
    grams = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    ids = [d for d in grams if d is not None]
    near = [(i, j) for i, a in enumerate(ids) for j, b in enumerate(ids[:i]) if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    least = dict(zip(ids, brute.components(ids, near)))
    assert gone("simhash_near_dedup") == {d for d in ids if least[d] != d} and 501 in gone("simhash_near_dedup")

    before, after = kept["benchmark_decontamination"]
    want = {r[0] for r in brute.decontaminate([(d, t) for d, t, _ in before], bench) if r[5] or r[2] >= 13}
    assert gone("benchmark_decontamination") == want and want

    before, after = kept["source_mixing"]
    size = lambda t: len((t or "").split())
    sizes, taken = {}, {}
    for _, t, s in before:
        sizes[s] = sizes.get(s, 0) + size(t)
    for _, t, s in after:
        taken[s] = taken.get(s, 0) + size(t)
    goal = mixing.targets(sizes)
    assert all(abs(taken.get(s, 0) - goal[s]) <= 40 for s in sizes) and set(after) <= set(before)

    before, after = kept["sharding"]
    assert sorted(map(repr, before)) == sorted(map(repr, after))
    by = {r["shard"]: r for r in now.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("u"), F.max("slot").alias("m")).collect()}
    assert all(r["n"] == r["u"] == r["m"] + 1 for r in by.values())
    assert max(r["b"] for r in by.values()) - min(r["b"] for r in by.values()) <= 3 * max(len((t or "").encode()) + 1 for _, t, _ in after)


def test_run_of_an_empty_corpus(spark, tmp_path):
    folder = data.write(
        spark, tmp_path, documents=spark.createDataFrame([], COLUMNS), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    assert corpus_pipeline.run(spark, folder).count() == 0


def near_corpus():
    """Texts with substitutions, so that pairs lie on both sides of 0.8, under a line that all share."""
    r = random.Random(5)
    prose = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = []
    for k in range(60):
        words = prose(r.randint(60, 300))
        for i in range(5):
            some = list(words)
            for at in r.sample(range(len(some)), r.randint(0, max(1, len(some) // 30))):
                some[at] = "new" + str(r.random())
            docs.append((1000 * i + k, " ".join(some), "en", "s0", 1))
    docs += [(6000 + i, "one two three four five six seven " + " ".join(prose(20)), "en", "s0", 1) for i in range(20)]
    return docs


def near_expected(docs):
    """doc_ids that stay: the least of each component of pairs at 0.8 or more."""
    grams = {}
    for d, t, *_ in docs:
        w = t.split()
        grams[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {d: d for d in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in root if root[d] == d}


def test_near_copies_are_those_at_four_fifths(spark, monkeypatch):
    docs = near_corpus()
    frame, want = spark.createDataFrame(docs, COLUMNS), near_expected(docs)
    assert 80 < len(want) < len(docs) - 80
    stay = lambda: sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect())
    assert stay() == sorted(want)
    # large groups: buckets joined to one text, parts of a few texts, one head or so
    for name, value in (("BUCKET", 2), ("MEMBERS", 3), ("HEADS", 1)):
        monkeypatch.setattr(nearcopies, name, value)
    assert stay() == sorted(want)


def test_texts_under_one_doc_id_are_told_apart(spark):
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80))
    a, b, c = prose(), prose(), prose()
    docs = [(1, a, "s0"), (1, b, "s0"), (2, c, "s0"), (1, a, "s0"), (1, a, "s1"), (5, b + " tail", "s0"), (None, a, "s0"), (None, a, "s0")]
    frame = spark.createDataFrame([(d, t, s, 9, "x", "y") for d, t, s in docs], "doc_id long, text string, source string, _t int, _doc string, text_key string")
    got = corpus_pipeline.drop_near_copies(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == sorted([(1, a), (1, b), (2, c), (None, a), (None, a)], key=repr)


def test_fingerprints_of_shingle_hashes():
    for text in ("", "a b", "a b c d e", *(t for _, t, *_ in near_corpus()[:20])):
        if text:
            assert nearcopies.fingerprint_of(nearcopies.hashes(text, 5)) == simhash.fingerprint(text, 5)
