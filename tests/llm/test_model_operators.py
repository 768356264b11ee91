import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeway.llm import common, extraction, mixing, pivots, queries, sharding, toxicity, training_pages, urls
from tests.llm import brute, data


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(r.randrange(400, 450), r.randrange(400, 450)) for _ in range(30)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {x: i for i, x in enumerate(nodes)}
    want = brute.components(nodes, [(at[a], at[b]) for a, b in edges if a != b])
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(spark, df, "a", "b").collect()}
    assert got == dict(zip(nodes, want))


# url filter


def page(host, path="/x", links=()):
    return (host + path, f"http://{host}{path}", "".join(f'<a class="b" href="{x}">t</a>' for x in links))


def test_rules_and_hosts(spark):
    rows = [
        "HTTP://WWW.Example.COM/en/1?x#y", "https://m.example.com/en/", "http://example.com/EN/", "http://net/es/a", "http://notexample.com/en/x",
        "http://a.net/de/", "http://a.com?x=/en/", "nohost", None, "", "x://y://z/en/",
    ]
    pages = spark.createDataFrame([(i, u, None, 1, "x") for i, u in enumerate(rows)], "page_id long, url string, html string, host int, trust string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(spark, pages).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("m.example.com", "/en/", "example.com/en/", "block"),
        2: ("example.com", "/EN/", "com/", "allow"), 3: ("net", "/es/a", "net/es/", "block"), 4: ("notexample.com", "/en/x", "com/", "allow"),
        5: ("a.net", "/de/", None, "allow"), 6: ("a.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("y:", "//z/en/", None, "allow"),
    }


def test_propagation_equals_power_iteration(spark):
    pages = [
        page("good.com", "/", ["http://a.org/", "//b.org/x", "/own"]), page("a.org", "/", ["http://b.org/1", "http://b.org/2", "http://good.com/"]),
        page("b.org", "/", []), page("farm.org", "/", ["https://bad.net/es/", "http://a.org/"]), page("bad.net", "/es/", ["http://farm.org/"]),
        page("lone.org"), page("lone.org"),
    ]
    got = {r["host"]: r for r in urls.judged(spark, spark.createDataFrame(pages, "page_id string, url string, html string")).collect()}
    hosts = ["good.com", "a.org", "b.org", "farm.org", "bad.net", "lone.org"]
    edges = {(0, 1): 1, (0, 2): 1, (1, 2): 2, (1, 0): 1, (3, 4): 1, (3, 1): 1, (4, 3): 1}

    def rank(edges, seed):
        start = np.eye(6)[seed]
        x = start
        for _ in range(urls.MOST_ROUNDS):
            y = np.zeros(6)
            for (a, b), w in edges.items():
                y[b] += x[a] * w / sum(v for (c, _), v in edges.items() if c == a)
            new = urls.DAMPING * y + (1 - urls.DAMPING * y.sum()) * start
            if np.abs(new - x).sum() < urls.CLOSE:
                return new
            x = new
        return x

    trust, distrust = rank(edges, 0), rank({(b, a): w for (a, b), w in edges.items()}, 4)
    for i, h in enumerate(hosts):
        assert got[h]["trust"] == pytest.approx(trust[i], abs=1e-9) and got[h]["distrust"] == pytest.approx(distrust[i], abs=1e-9)
    assert {h: got[h]["verdict"] for h in hosts} == dict(zip(hosts, ["allow", "allow", "allow", "block", "block", "allow"]))


def test_distrust_runs_along_a_long_chain(spark):
    """60 hosts that nobody rules, each linking on to the next, the last to a blocked one; and their mirror from a trusted one."""
    pages = [page(f"h{i}.org", "/", [f"http://h{i + 1}.org/" if i < 59 else "http://bad.net/es/"]) for i in range(60)]
    pages += [page("bad.net", "/es/"), page("good.com", "/", ["http://g0.org/"])] + [page(f"g{i}.org", "/", [f"http://g{i + 1}.org/"]) for i in range(5)]
    got = {r["host"]: r["verdict"] for r in urls.judged(spark, spark.createDataFrame(pages, "page_id string, url string, html string")).collect()}
    assert all(got[f"h{i}.org"] == "block" for i in range(60)) and all(got[f"g{i}.org"] == "allow" for i in range(5))


def test_urls_of_empty_and_long_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert queries.QUERIES["op1_url_filter"](spark, data.write(spark, tmp_path, pages=empty)).count() == 0
    long = [(1, "http://a.org/x", "<p>word</p>" * 100_000 + '<a href="http://bad.net/es/">x</a>'), (2, "http://bad.net/es/", None), (1, "http://a.org/x", "")]
    got = urls.judged(spark, spark.createDataFrame(long, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["verdict"]) for r in sorted(got, key=lambda r: r["page_id"])] == [(1, "block"), (1, "block"), (2, "block")]


# toxicity


def labelled(n=400, seed=3):
    r = random.Random(seed)
    neutral, insults = [f"word{i}" for i in range(80)], ["gromp", "grompish", "blafnik"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(neutral) for _ in range(r.randint(5, 40))] + ([r.choice(insults)] if toxic else [])
        if toxic and i % 8 == 0 or r.random() < 0.05:
            words.append("muslim")  # a biased sample names one group with insults
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_ignores_groups(spark, tmp_path, monkeypatch):
    docs, labels = labelled()
    extra = [(1000, None), (1001, ""), (1002, "my muslim neighbours word3 word9"), (1003, "a " * 200_000 + "gromp"), (0, docs[0][1])]
    frame = data.frame(spark, docs + extra).withColumn("toxicity", data_lit("x")).withColumn("label", data_lit("y"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    folder = data.write(spark, tmp_path, documents=frame, labels=lab)
    got = queries.QUERIES["op2_toxicity"](spark, folder).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    by = {r["doc_id"]: r for r in got}
    assert by[1002]["predicted"] == 0 and by[1003]["predicted"] == 1 and by[1000]["score"] == by[1001]["score"]


def data_lit(x):

    return F.lit(x)


def test_penalty_shrinks_the_swing_of_identity_terms(monkeypatch):
    docs, labels = labelled()
    y = np.array([t for _, _, t in labels])
    words = [toxicity.words(t) for _, t in docs]
    arr = lambda ws: None if ws is None else np.array(sorted({f for w in ws for f in toxicity.features_of(w)}), np.int32)
    own, other = [arr(w) for w in words], [arr(toxicity.swapped(w)) for w in words]
    swing, full = {}, toxicity.PENALTY
    for penalty in (0.0, full):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        model = toxicity.fit(y, own, other)
        swing[penalty] = abs(model.score("muslim") - model.score("christian"))
    assert swing[full] < 0.5 * swing[0.0]


def test_toxicity_without_labels(spark, tmp_path):
    folder = data.write(spark, tmp_path, documents=data.frame(spark, [(1, "x")]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    (row,) = queries.QUERIES["op2_toxicity"](spark, folder).collect()
    assert 0 <= row["score"] < 0.7 and row["predicted"] == 0


def test_toxicity_of_awkward_rows(spark, tmp_path):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    folder = data.write(spark, tmp_path, documents=data.frame(spark, [*docs, (None, "gromp"), (None, None)]), labels=lab)
    got = queries.QUERIES["op2_toxicity"](spark, folder).where("doc_id is null").collect()
    assert [r["held_out"] for r in got] == [False, False]
    empty = data.write(spark, tmp_path / "none", documents=data.frame(spark, []), labels=lab)
    assert queries.QUERIES["op2_toxicity"](spark, empty).count() == 0


def test_toxicity_equals_plain_scores(spark, tmp_path):
    """Every score is the logistic of the bias and the weights of the features of the text's distinct words."""
    docs, labels = labelled()
    frame, lab = data.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, frame, lab, f"not ({queries.HELD_OUT})")
    for r in toxicity.scored(spark, frame, model).collect():
        active = {f for w in set(toxicity._WORD.findall(r["text"].lower())) for f in toxicity.features_of(w)}
        assert r["toxicity"] == pytest.approx(1 / (1 + math.exp(-model.bias - sum(w for f, w in model.weights.items() if f in active))))


# sharding


@pytest.mark.parametrize("copies", [0, 400])
def test_shards_have_equal_bytes(spark, tmp_path, copies):
    r = random.Random(4)
    docs = [(i, "".join(r.choice("abé ") for _ in range(r.randint(0, 60)))) for i in range(800)] + [(None, None), (None, ""), (3, None), (7, "x"), (7, "x")]
    docs += [(5000 + i, "the same text") for i in range(copies)]
    folder = data.write(spark, tmp_path, documents=data.frame(spark, docs))
    got = queries.QUERIES["op4_histogram_sharding"](spark, folder).collect()
    import zlib

    want = sorted((repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    total, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) - min(total) <= 0.002 * sum(total) / 8 + 2 * max(r["size"] for r in got)


def test_tasks_share_a_text_of_most_rows(spark):
    docs = data.frame(spark, [(i, "the same text") for i in range(900)] + [(1000 + i, f"text {i}") for i in range(100)])
    got = sharding.sharded(spark, docs, 3).withColumn("part", F.spark_partition_id()).collect()
    rows, of_part = {}, {}
    for r in got:
        rows.setdefault(r["shard"], []).append(r["slot"])
        if r["doc_id"] < 900:
            of_part[r["part"]] = of_part.get(r["part"], 0) + 1
    assert sorted(rows) == [0, 1, 2] and all(sorted(s) == list(range(len(s))) for s in rows.values())
    assert sum(of_part.values()) == 900 and max(of_part.values()) <= 250


@pytest.mark.parametrize("rows", [[(1, "x")] * 800, [(1, "same text")] * 500 + [(i, "same text") for i in range(300)] + [(i, f"t{i}") for i in range(90)] + [(None, "é" * 40_000)], [(None, None)] * 21])
def test_law_of_bytes_holds_for_equal_rows(spark, tmp_path, rows):
    """As plain counting has it: in the order of the keys, shard i starts where i eighths of the bytes are below."""
    folder = data.write(spark, tmp_path, documents=data.frame(spark, rows))
    got = queries.QUERIES["op4_histogram_sharding"](spark, folder).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(d), size(t)) for d, t in rows)
    total, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean, largest = sum(total) / 8, max(size(t) for _, t in rows)
    assert all(abs(sum(total[: i + 1]) - mean * (i + 1)) <= largest + 0.0005 * mean for i in range(8)), total


@pytest.mark.parametrize("rows", [[], [(1, "x")], [(9, "same")] * 30])
def test_shards_of_awkward_tables(spark, tmp_path, rows):
    folder = data.write(spark, tmp_path, documents=data.frame(spark, rows))
    got = queries.QUERIES["op4_histogram_sharding"](spark, folder).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# extraction


def test_minimum_cut_is_the_least(monkeypatch):
    r = random.Random(6)
    for _ in range(60):
        n = r.randint(1, 9)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.4}

        def cost(on):
            return sum(-s if o and s < 0 else s if not o and s > 0 else 0 for s, o in zip(scores, on)) + sum(c for (i, j), c in edges.items() if on[i] != on[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(extraction.minimum_cut(scores, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="content">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make things better for all of you, dear readers of this page.</div>
<!-- ad --><div class="ad">Buy this now</div><article><header><h1>The &amp; heading</h1></header><p>First   para&shy;graph with
some <b>bold &eacute;</b> and <a href="/c">a link</a>.<p>Second paragraph<br>goes on, 3 &lt; 4.<form><input value="q"><label>Mail</label></form>
<ul><li>item one</li><li>item two</li></ul></article><aside>Related things</aside><section id="comments"><p>A reader says that this is a long comment with many words in it indeed.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_article_without_boilerplate():
    assert extraction.main_text(PAGE) == "The & heading\nFirst para\u00adgraph with some bold é and a link.\nSecond paragraph goes on, 3 < 4.\nitem one\nitem two"


def test_the_cut_mends_what_the_model_alone_gets_wrong():
    weights, strength = extraction.model()
    alone = cut = 0
    for seed in range(50_000, 50_150):
        html, content = training_pages.page(seed)
        tree = extraction.blocks_of(html)
        scores = [float(np.dot(weights, extraction.features(b))) for b in tree.blocks]
        labels = extraction.minimum_cut(scores, extraction.smoothness(tree, strength))
        assert "\n".join(b.text for b, on in zip(tree.blocks, labels) if on) == extraction.main_text(html)
        alone += sum((s > 0) != (b.text in content) for s, b in zip(scores, tree.blocks))
        cut += sum(on != (b.text in content) for on, b in zip(labels, tree.blocks))
    assert strength > 0 and cut < 0.6 * alone


def test_pages_equal_all_cuts_tried():
    """Small pages against every labelling of their blocks."""
    weights, strength = extraction.model()
    done = 0
    for seed in range(60_000, 60_400):
        html, _ = training_pages.page(seed)
        tree = extraction.blocks_of(html)
        n = len(tree.blocks)
        if n > 11:
            continue
        done += 1
        scores = [float(np.dot(weights, extraction.features(b))) for b in tree.blocks]
        edges = extraction.smoothness(tree, strength)
        on = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
        cost = sum(np.where(on[:, i], max(0, -s), max(0, s)) for i, s in enumerate(scores)) + sum(c * (on[:, i] != on[:, j]) for (i, j), c in edges.items())
        best = on[int(np.argmin(cost))]
        assert extraction.main_text(html) == "\n".join(b.text for b, x in zip(tree.blocks, best) if x)
    assert done >= 10


def test_deep_nesting_costs_no_square():
    import time

    began = time.time()
    assert extraction.main_text("<article>" + "<div>" * 20_000 + "<p>some words here</p>" * 2000 + "</x>" * 20_000).count("\n") == 1999
    assert time.time() - began < 5


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert queries.QUERIES["op5_html_extraction"](spark, data.write(spark, tmp_path, pages=empty)).count() == 0


def test_pages_without_markup_of_their_parts():
    prose = "This is a plain paragraph with quite a number of words, which goes on and on, so that it reads like an article."
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div><p>{prose}</p><p>{prose}</p><p>Short.</p><p>{prose}</p></div><div><a href=3>About</a></div>"
    assert extraction.main_text(page).split("\n") == [prose, prose, "Short.", prose]


def test_awkward_pages(spark, tmp_path):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "plain text only, without any markup at all, but long enough to be read as content of its own"),
        (4, "u", "<p " + "x" * 1000), (5, "u", "<article><p>a<b>b</p><p>" + "word " * 100_000 + "</p>"), (None, "u", "<article>ok, fine</article>"), (1, "u", None),
        (6, "u", "<article><p title='a>b'>quoted</p><script>x<p>y"), (7, "u", "<article>" + "<div>" * 3000 + "deep text here"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = queries.QUERIES["op5_html_extraction"](spark, data.write(spark, tmp_path, pages=df)).collect()
    texts = sorted(((r["page_id"] or 0, r["text"]) for r in got))
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = dict(texts)
    assert by[1] == by[2] == "" and by[0] == "ok, fine" and by[6] == "quoted" and by[7] == "deep text here" and len(by[5].split()) == 100_001 and by[3].startswith("plain")


# embeddings


def clustered(seed=8, n=240, dim=24):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centers[i % 12] + r.standard_normal(dim) * r.choice([0.02, 0.15, 0.5])
        rows.append((i * 7 % 997, v.astype(np.float32).tolist(), int(i % 12 > 8)))
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [float("nan")] * dim, 1), (3004, [None] + [1.0] * (dim - 1), 1), (3005, [1.0, 0.0], 1)]
    rows += [(3006, [2.0, 0.0], 1), (3007, rows[0][1], None), (None, rows[0][1], 0), (3008, [float("inf")] * dim, 1), rows[0], (3009, [3e38] * dim, 1), (3010, [1e-38] * dim, 1)]
    return rows


def brute_links(rows, least=0.98):
    ok, unit = [], []
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(bool(good))
        if good:
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            unit.append(x / np.sqrt(x @ x))
        else:
            unit.append(None)
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least
    ]
    comp = brute.components([r[0] for r in rows], pairs)
    n = [sum(i in p for p in pairs) for i in range(len(rows))]
    return sorted(((r[0], k, c if o else r[0]) for r, k, c, o in zip(rows, n, comp, ok)), key=repr)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_embedding_links_equal_brute_force(spark, chunk):
    rows = clustered()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int, dim int")
    got = pivots.near_duplicates(spark, df, chunk=chunk)
    got, want = data.rows(got, "vec_id", "n_links", "component_id"), brute_links(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g != w for g, w in zip(got, want)) <= 0.05 * len(want)


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pivots.near_duplicates(spark, df).count() == 0


# mixing


def test_flow_is_cheapest():
    r = random.Random(9)
    for _ in range(20):
        net, n = mixing.MinCostFlow(6), 6
        arcs = [(a, b, r.randint(1, 3), r.randint(0, 3)) for a in range(n) for b in range(n) if a != b and r.random() < 0.5]
        edges = [net.add(*x) for x in arcs]
        net.run(0, 5)
        flow = [net.flow(e) for e in edges]
        # no path is left, and no cycle of negative cost: the conditions of a cheapest maximum flow
        left = [(a, b, w) for (a, b, c, w), f in zip(arcs, flow) if f < c] + [(b, a, -w) for (a, b, c, w), f in zip(arcs, flow) if f]
        seen = {0}
        for _ in range(n):
            seen |= {b for a, b, _ in left if a in seen}
        assert 5 not in seen
        d = [0] * n
        for _ in range(n):
            for a, b, w in left:
                d[b] = min(d[b], d[a] + w)
        assert all(d[b] <= d[a] + w for a, b, w in left)


def test_targets_fill_up_and_stop():
    got = mixing.targets({"a": 600, "b": 300, None: 10, "c": 90})
    assert got[None] == 30 and got["c"] == 270 and sum(got.values()) == pytest.approx(1000)
    assert got["b"] / got["a"] == pytest.approx(2)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def mix_documents():
    r = random.Random(10)
    sources = ["s1", "S2", "é3", None, "tiny", "empty"]
    texts = [" ".join(r.choice("abcdef") * 3 for _ in range(r.randint(1, 60))) for _ in range(300)]
    docs = [(i, t, r.choice(sources[:4])) for i, t in enumerate(texts)]
    docs += [(400 + i, texts[i % 20], sources[i % 4]) for i in range(120)] + [(600, "one two three", "tiny"), (601, None, "empty"), (602, "", "empty"), docs[0]]
    return docs


def test_mix_comes_near_targets(spark, tmp_path):
    docs = mix_documents()
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, p int, s int, size int")
    folder = data.write(spark, tmp_path, documents=df)
    got = queries.QUERIES["op9_source_mixing"](spark, folder).collect()
    again = queries.QUERIES["op9_source_mixing"](spark, folder).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal, taken = mixing.targets(sizes), dict.fromkeys(sizes, 0)
    want = sorted(((d, len((t or "").split()), s) for d, t, s in docs), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in got), key=repr) == want
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 30 for s in sizes), (taken, goal)


def test_mix_of_nothing(spark, tmp_path):
    assert queries.QUERIES["op9_source_mixing"](spark, data.write(spark, tmp_path, documents=data.frame(spark, []))).count() == 0


def test_mix_routes_every_pattern(spark, monkeypatch):
    docs = [(k, f"text {k} of these sources", f"s{i:02}") for k in range(1, 2**11) for i in range(11) if k >> i & 1]
    seen, routed = [], mixing.routed
    monkeypatch.setattr(mixing, "routed", lambda own, once, quotas: seen.append(once) or routed(own, once, quotas))
    got = mixing.mixed(spark, spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(got) == len(docs) and sum(p >= 11 for p in seen[0]) == 2**11 - 12


def test_mix_fills_at_every_size(spark, monkeypatch):
    df = spark.createDataFrame(mix_documents(), "doc_id long, text string, source string")
    rows = lambda: sorted(map(repr, mixing.mixed(spark, df).collect()))
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rows() == want
