import math

import pytest
from pyspark.sql import functions as F

from lodeway.operators import analytics, build, extract, lexical, lookup, rank, regex, render, rollup, sanitize, store, traverse, vectors
from lodeway.sources import files as sources
from lodeway.streaming import watch

ENT = "file string, name string, type string, description string, line_start long, traits string"
REL = "file string, from_name string, relation string, to_name string"


def rel(spark, rows):
    return spark.createDataFrame(rows, REL)


def ent(spark, rows):
    return spark.createDataFrame([(f, n, t, "", line, "") for f, n, t, line in rows], ENT)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_bm25_by_hand(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "f", 1, "apple banana apple"), (2, "f", 1, "apple cherry"), (3, "f", 1, "banana kiwi plum kiwi")], "chunk_id int, file string, line_start int, text string")
    got = {r["chunk_id"]: r["bm25"] for r in lexical.bm25(lexical.build_index(chunks, f"file://{tmp_path}/i"), "apple kiwi kiwi").collect()}
    df = {"apple": 2, "banana": 2, "cherry": 1, "kiwi": 1, "plum": 1}
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / 5
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    score = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 3))
    assert got == pytest.approx({1: score("apple", 2, 3), 2: score("apple", 1, 2), 3: 2 * score("kiwi", 2, 4)})


def test_index_is_kept_by_fingerprint(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "f", 1, "apple banana")], "chunk_id int, file string, line_start int, text string")
    base = f"file://{tmp_path}"
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "file string, mtime long, length long")
    key = lexical.fingerprint(files)
    assert key == lexical.fingerprint(files.orderBy(F.desc("file"))) != lexical.fingerprint(files.withColumn("mtime", F.col("mtime") + 1))
    lexical.index_of(chunks, "x", key, base)
    again = lexical.index_of(chunks.withColumn("text", F.lit("other")), "x", key, base)
    assert {r["term"] for r in again.terms.collect()} == {"apple", "banana"}
    empty = lexical.index_of(chunks.limit(0), "x", "new", base)
    assert empty.n == 0 and lexical.bm25(empty, "apple").count() == 0 and [p.name for p in (tmp_path / "search-x").iterdir() if p.is_dir()] == ["new"]


def test_failing_reranker_keeps_the_pool(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "f", 1, f"alpha foo-bar word{i}") for i in range(5)], "chunk_id long, file string, line_start int, text string")
    dense = chunks.select("chunk_id", (F.col("chunk_id") / 10).alias("dense"))

    def broken(query, texts):
        raise RuntimeError

    assert [r["chunk_id"] for r in lexical.hybrid(lexical.build_index(chunks, f"file://{tmp_path}/i"), dense, "alpha foo-bar", final=3, reranker=broken).collect()] == [4, 3, 2]


def test_usages_count_dotted_leaves(spark):
    rows = rel(spark, [("a", "x", "calls", "f"), ("b", "y", "imports", "pkg.f"), ("c", "z", "calls", "ff")])
    assert collected(lookup.find_usages(rows, "f")) == [("a", "x", "calls", "f"), ("b", "y", "imports", "pkg.f")]
    assert collected(lookup.get_callers(rows, "f")) == [("a", "x")]


def test_affected_files(spark):
    ents = ent(spark, [("src/m/e.py", "Mode", "class", 1)])
    rows = rel(spark, [("a", "x", "uses", "Mode"), ("b", "y", "imports", "src.m.e.Mode"), ("c", "z", "imports", "m.e"), ("d", "z", "defines", "Mode"), ("e", "z", "imports", "other")])
    assert collected(lookup.affected_files(ents, rows, "src/m/e.py")) == [("a",), ("b",), ("c",), ("src/m/e.py",)]


def test_pending_precedence(spark):
    disk = spark.createDataFrame([("new", 1), ("old", 2), ("wait", 3), ("ok", 4)], "file string, mtime long")
    meta = spark.createDataFrame([("old", 1, False), ("wait", 3, False), ("ok", 4, True), ("gone", 1, True)], "file string, mtime long, incoming_done boolean")
    assert collected(lookup.pending(disk, meta)) == [("gone", "missing"), ("new", "unindexed"), ("old", "stale"), ("wait", "needs_incoming")]


def test_upsert_keeps_richer_values(spark):
    old = spark.createDataFrame([("f", "a", "class", "rich", 5, "x"), ("f", "b", "class", "only", 1, "y")], ENT)
    new = spark.createDataFrame([("f", "a", "class", "", None, "z"), ("f", "c", "class", "new", 9, "")], ENT)
    assert collected(store.upsert_entities(old, new)) == [("f", "a", "class", "rich", 5, "z"), ("f", "b", "class", "only", 1, "y"), ("f", "c", "class", "new", 9, "")]


def test_calls_hide_uses_and_ends_must_be_known(spark):
    rows = rel(spark, [("f", "a", "calls", "b"), ("f", "a", "uses", "b"), ("f", "x", "calls", "y"), ("f", "a", "eats", "b"), ("f", "f", "defines", "g.py"), ("f", "f", "defines", "a")])
    assert collected(sanitize.relations(rows, ent(spark, [("f", "a", "class", 1)]))) == [("f", "a", "calls", "b"), ("f", "f", "defines", "a")]


def test_entities_are_cleaned(spark):
    rows = spark.createDataFrame(
        [("f.py", "A", "struct", "d", None), ("f.py", "B", "gizmo", " a  b ", "x"), ("f.py", "other.ts", "class", "", ""), ("f.md", "f.md", "module", "", ""), (".env", "K", "variable", "s3cret", "")],
        "file string, name string, type string, description string, tags string",
    )
    got = {r["name"]: (r["type"], r["description"], r["tags"]) for r in sanitize.entities(rows).collect()}
    assert got == {"A": ("class", "d", []), "B": ("symbol", "a b", ["x", "gizmo"]), "f.md": ("doc", "", []), "K": ("variable", "", [])}


def test_locator_prefers_definitions(spark):
    text = "# foo is great\nimport x\ndef foo():\n  pass\nclass C:\n  def login(self):"
    files = spark.createDataFrame([("a.py", text)], "file string, text string")
    names = spark.createDataFrame([("a.py", "foo"), ("a.py", "C.login"), ("a.py", "nothing")], "file string, name string")
    got = {r["name"]: (r["line_start"], r["line_end"]) for r in extract.locate(names, files).collect()}
    assert got == {"foo": (3, 5), "C.login": (6, 6), "nothing": (None, None)}


def test_all_line_ends_count(spark):
    files = spark.createDataFrame([("a.py", "x\r\ny\rdef foo():\n"), ("b.py", "")], "file string, text string")
    names = spark.createDataFrame([("a.py", "foo"), ("b.py", "foo"), ("a.py", "y.")], "file string, name string")
    got = {(r["file"], r["name"]): (r["line_start"], r["line_end"], r["snippet"]) for r in extract.locate(names, files).collect()}
    assert got == {("a.py", "foo"): (3, 3, "x\ny\ndef foo():"), ("b.py", "foo"): (None, None, None), ("a.py", "y."): (None, None, None)}
    assert collected(regex.raw_occurrences(files, "FOO")) == [("a.py", 3, "x\ny\ndef foo():")]
    assert collected(extract.fixed_chunks(files, 2)) == [("a.py", 1, "x\ny"), ("a.py", 3, "def foo():")]


def test_structured_files_go_to_their_rules(spark):
    files = spark.createDataFrame(
        [("a.scss", ".a { color: red } @import 'b.css';"), ("c.json", "{/* c */ 'k': 1, b: [1,],}"), ("d.html", '<x-y class="u v" [v]="go()"></x-y>'), ("e.py", "k = 1")], "file string, text string",
    )
    entities, relations = extract.structured(files)
    assert collected(entities) == [
        ("a.scss", ".a", "selector"), ("a.scss", "b.css", "import"), ("c.json", "b", "variable"), ("c.json", "k", "variable"), ("d.html", ".u", "selector"), ("d.html", ".v", "selector"), ("d.html", "x-y", "component"),
    ]
    assert ("d.html", "d.html", "calls", "go") in collected(relations) and ("a.scss", "a.scss", "imports", "b.css") in collected(relations)
    assert not any(r["file"] == "e.py" for r in relations.collect())


def test_structured_equals_its_rules_in_one_pass(spark):
    files = spark.createDataFrame(
        [
            ("a.scss", "\n @media x { .a,\n.b  c , { --v: 1; --v : 2 } .a { } } @import url('x.css'); @import 'x.css'"), ("a.scss", ".a {} .z {}"), ("b.css", None), ("c.css", ""),
            ("d.json", '{"k": 1, "k2": {"n": 2}}'), ("d.json", '{"k": 3, "": 4}'), ("e.JSON5", "{a: 1,}"), ("f.json", "no json\nkey: 1\n key  = 2"), ("g.yaml", "a.b: 1\nx\na.b: 2"), (".env", "A=1\n" + "B" * 200 + "=2"),
            ("h.toml", "a = 1\n[t.u]\nb = 2"), ("i.toml", "wrong = = 1"), (".toml", "q = 1"), ("j.html.toml", "<p>"),
            ("k.html", '<p class=" u\n v " id="m n"><x-y [v]="go(a) && go" (c)="b.c(this)"></x-y>{{ go }} {{ p() }} @let z = w; <p><o:p>'), ("k.html", "{{ b() }} <x-y>"), ("l.vue", None), ("m.htm", ""),
            ("n.py", "k: 1 { }"), (None, "k: 1"), ("", "k: 1"),
        ],
        "file string, text string",
    )
    of = {k: files.where(extract.strategy(F.col("file")) == k) for k in ("style", "config", "template")}
    keys, kinds = extract.config_keys(of["config"]), lambda rows: {(r["file"], r["name"], r["type"], r["relation"]) for r in rows.collect()}
    named = kinds(extract.stylesheet(of["style"])) | {(*r, "variable", "defines") for r in collected(keys)} | kinds(extract.template_tags(of["template"]))
    named |= {(*r, "selector", "defines") for r in collected(extract.template_selectors(of["template"]))}
    references = {(r["file"], r["file"], r["relation"], r["name"]) for r in extract.template_references(of["template"]).collect()}
    assert len(named) > 20 and len(references) > 5
    entities, relations = extract.structured(files)
    assert collected(entities) == sorted({n[:3] for n in named})
    assert collected(relations) == sorted({(f, f, r, n) for f, n, _, r in named} | references)
    # each file is read once, TOML once more, and a count by file needs no further exchange
    plan = relations.groupBy("file").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Exchange hashpartitioning(file") == 1, plan


def test_replies_of_models_are_read_leniently():
    assert sources.reply_payload('Here:\n```json\n{"entities": [{"name": "a//b", "type": "x,]"},], // all\n}\n```') == {"entities": [{"name": "a//b", "type": "x,]"}]}
    assert sources.reply_payload("[1]") == sources.reply_payload("sorry") == sources.reply_payload("") == {}
    assert sources.prompted(lambda file, code: f'{{"entities": [{{"name": "{code}"}}]}}', 3)("f", "abcdef") == {"entities": [{"name": "abc"}]}


def test_an_extractor_is_called_once_a_file_and_gets_few_texts_at_a_time(spark):
    calls = spark.sparkContext.accumulator(0)

    def tell(file, text):
        calls.add(1)
        if text is None:
            raise ValueError
        return {"entities": [{"name": text, "type": "fn", "more": 1}], "relations": [{"from": text, "relation": "calls"}]} if text else {}

    told = sources.extract_with(spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "file string, text string"), tell)
    assert collected(told.where("size(entities) >= 0")) == [("a", [("x", "fn", None, None)], [("x", "calls", None)]), ("b", [], []), ("c", [], [])]
    assert calls.value == 3
    # Arrow batches hold 10,000 whole texts
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan and "MapInPandas" not in plan


def test_find_entity_falls_back(spark):
    ents = ent(spark, [("f", "loadUser", "function", 1), ("g", "saveUser", "function", 2), ("h", "Cart", "class", 3)])
    vecs = spark.createDataFrame([("loadUser", [0.2, 0.0]), ("saveUser", [0.9, 0.0]), ("Cart", [0.0, 1.0])], "name string, embedding array<double>")
    files = spark.createDataFrame([("t.md", "one\nzzz here")], "file string, text string")
    ask = lambda q, **kw: [(r["name"], r["found"]) for r in lookup.find_entity(ents, q, embeddings=vecs, encode=lambda q: [1.0, 0.0], files=files, **kw).collect()]
    assert ask("user") == [("saveUser", "name"), ("loadUser", "name")]
    assert ask("zzz") == [("loadUser", "vector"), ("saveUser", "vector")]
    assert ask("zzz", kind="class") == [] and [n for n, _ in ask("")] == ["Cart", "loadUser", "saveUser"]
    assert [tuple(r)[:5] for r in lookup.find_entity(ents, "zzz", files=files).collect()] == [("t.md", "zzz", "symbol", "Raw text match, no entity of the graph", 2)]
    assert lookup.find_entity(ents, "nowhere", files=files).count() == 0


def test_clones_leave_out_rows_of_one_name(spark):
    rows = spark.createDataFrame([(1, "a", "f", "function", 1), (2, "b", "g", "function", 2), (3, "a", "f", "method", 3), (4, "c", "h", "variable", 4)], "vec_id long, file string, name string, type string, line_start long")
    vecs = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3, 4)], "vec_id long, embedding array<double>")
    rels = rel(spark, [(f, n, "calls", "x") for f, n in (("a", "f"), ("b", "g"), ("c", "h"))])
    (got,) = analytics.find_clones(rows, rels, vecs).collect()
    assert [m["name"] for m in got["members"]] == ["f", "f", "g"] and got["n_pairs"] == 2
    assert analytics.find_clones(rows, rels.limit(0), vecs).count() == 0


def test_template_calls_and_config(spark):
    files = spark.createDataFrame([("a.html", '<x-y (click)="count()" [v]="index"></x-y>@if (ready) { {{ u.name() }}')], "file string, text string")
    assert {(r["relation"], r["name"]) for r in extract.template_references(files).collect()} == {("calls", "count"), ("calls", "name"), ("uses", "u"), ("uses", "ready")}
    configs = spark.createDataFrame([("a.toml", 'x = 1\n[t]\ny = 2'), ("b.json", '{"k": {"z": 1}}'), ("c.yaml", "a: 1\n  b: 2"), ("d.toml", "= bad\nq = 1")], "file string, text string")
    assert collected(extract.config_keys(configs)) == [("a.toml", "t"), ("a.toml", "x"), ("b.json", "k"), ("c.yaml", "a"), ("c.yaml", "b"), ("d.toml", "q")]


def test_chunks(spark):
    files = spark.createDataFrame([("a", "\n".join(f"line {i} of some text" for i in range(100))), ("b", "short text here"), ("c", "tiny"), ("d", None)], "file string, text string")
    assert collected(extract.chunks(files).select("file", "line_start")) == [("a", 1), ("a", 46), ("a", 91), ("b", 1)]


def test_dead_code_is_verified(spark):
    ents = ent(spark, [("a.py", "waitForAgent", "function", 1), ("a.py", "orphan", "function", 5), ("a.py", "used", "function", 9), ("tests/t.py", "helper", "function", 1), ("x.pipe.ts", "go", "method", 1)])
    rows = rel(spark, [("b.py", "m", "calls", "used")])
    assert {r["name"] for r in analytics.dead_code(ents, rows).collect()} == {"waitForAgent", "orphan"}
    files = spark.createDataFrame([("a.py", "def waitForAgent():\n\n\n\ndef orphan():\n# orphan is dead"), ("b.ts", "const ready = await waitForAgent();")], "file string, text string")
    assert {r["name"] for r in analytics.dead_code(ents, rows, files=files).collect()} == {"orphan"}


def test_coverage_reads_dotted_imports(spark):
    ents = ent(spark, [("src/e.py", "ChatMode", "class", 1), ("src/e.py", "Other", "class", 2)])
    rows = rel(spark, [("tests/test_e.py", "t", "imports", "src.models.enums.ChatMode"), ("tests/test_e.py", "t", "inherits", "Other")])
    assert {(r["name"], r["covered"]) for r in analytics.production(ents, rows).collect()} == {("ChatMode", True), ("Other", False)}


def test_subgraph_stops_at_hubs_and_caps(spark):
    ents = ent(spark, [(f"f{i}", "hub", "class", 1) for i in range(10)] + [("f", "a", "class", 1)])
    rows = rel(spark, [("f", "a", "calls", "hub"), ("f", "a", "calls", "b"), ("f", "hub", "calls", "z"), ("f", "b", "calls", "c"), ("f", "c", "calls", "d")] + [("g", "b", "uses", f"u{i}") for i in range(5)])
    edges, nodes = traverse.subgraph(ents, rows, "a", depth=1, cap=3)
    assert {(r["name"], r["state"]) for r in nodes.collect()} == {("a", "expanded"), ("hub", "hub"), ("b", "truncated")}
    assert ("hub", "calls", "z") not in collected(edges) and len(collected(edges)) == 4


def test_pagerank_with_a_dangling_node(spark):
    ranked = spark.createDataFrame([("f", n, "class", 1) for n in "abcd"], "file string, name string, type string, line_start int")
    links = spark.createDataFrame([("f\na", "f\nb", 2), ("f\na", "f\nc", 1), ("f\nb", "f\nc", 1), ("f\nc", "f\na", 1)], "src string, dst string, weight int")
    got = {r["node"][2:]: r["score"] for r in rank.pagerank(ranked, links, focus_names=["d"], tolerance=1e-9).collect()}
    p, x = {"a": 1 / 54, "b": 1 / 54, "c": 1 / 54, "d": 51 / 54}, dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        into = {"a": x["c"], "b": x["a"] * 2 / 3, "c": x["a"] / 3 + x["b"], "d": 0}
        x = {n: 0.85 * (into[n] + x["d"] * p[n]) + 0.15 * p[n] for n in x}
    assert got == pytest.approx(x, abs=1e-6)
    few = rank.budgeted(ranked, spark.createDataFrame(list({f"f\n{k}": v for k, v in got.items()}.items()), "node string, score double"), tokens=10)
    assert few.count() == 4


def test_links_are_found_once_and_go_to_the_nearest_definition(spark):
    ents = ent(spark, [(f, "same", "function", 1) for f in "cab"] + [(f"h{i}", "hub", "class", 1) for i in range(10)] + [("b", "x", "function", 1), ("d", "y", "function", 2), ("d", "gone", "template", 3)])
    names = [("a", "same"), ("b", "same"), ("c", "same"), ("b", "x"), ("d", "y")] + [(f"h{i}", "hub") for i in range(10)]
    rows = rel(spark, [(f, f, "defines", n) for f, n in names] + [("b", "x", "calls", "same"), ("b", "x", "uses", "same"), ("d", "y", "calls", "same"), ("d", "y", "calls", "hub"), ("d", "y", "calls", "y"), ("d", "y", "calls", "zz"), ("q", "q", "calls", "x"), (None, "y", "calls", "x"), ("d", "y", "uses", None)])
    ranked, calls = rank.nodes(ents, rows), spark.sparkContext.accumulator(0)
    links = rank.edges(ranked, ents, rows)
    assert collected(links) == [("b\nx", "b\nsame", 2), ("d\ny", "a\nsame", 1)]
    # a reference is dealt by what refers and by what it names, and is not sorted for a choice
    assert "Window" not in links._jdf.queryExecution().executedPlan().toString()

    @F.udf("string", useArrow=False)
    def counted(x):
        calls.add(1)
        return x

    rank.pagerank(ranked, links.coalesce(1).withColumn("src", counted.asNondeterministic()("src")), rounds=1).collect()
    assert calls.value == 2


def test_clusters_and_neighbours(spark):
    v = spark.createDataFrame([(i, [math.cos(a), math.sin(a)]) for i, a in enumerate((0, 0.1, 0.2, 2.0, 2.1))], "vec_id long, embedding array<double>")
    near = vectors.neighbours(v, 2, block=2)
    assert {(r["query"], r["neighbour"]) for r in near.collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 1), (2, 0), (3, 4), (3, 2), (4, 3), (4, 2)}
    shapes = v.select(F.col("vec_id").alias("id"), F.array(F.lit("s")).alias("shape"))
    rows = analytics.clusters(analytics.clone_pairs(near, shapes, 0.99))
    assert {(r["component"], r["members"], r["n_pairs"]) for r in rows.collect()} == {(0, "0,1,2", 2), (3, "3,4", 1)}


def test_regex_positions_and_prefilter(spark):
    assert regex.safe_literals(r"\bstartAgentWorker\b") == ["startAgentWorker"] and regex.safe_literals("TODO|FIXME") == []
    files = spark.createDataFrame([("a.py", "x\nTODO one\n FIXME\n" + "y\n" * 120 + "call(TODO, 2)")], "file string, text string")
    got = [(r["line"], r["match"], r["context"]) for r in regex.search(files, "TODO|FIXME").collect()]
    assert got == [(2, "TODO", "TODO one"), (3, "FIXME", " FIXME"), (124, "TODO", "call(TODO, 2)")]
    assert [r["line"] for r in regex.structural(files, "call($A, $B)").collect()] == [124]
    assert [r["line"] for r in regex.raw_occurrences(files, "fixme").collect()] == [3]
    assert regex.search(files, "TODO", glob="*.ts").count() == 0


def test_rollup_drops_ambiguous_names(spark):
    ents = ent(spark, [("m/a", "one", "class", 1), ("m/b", "two", "class", 1), ("n/c", "two", "class", 1), ("n/d", "two", "class", 1)])
    rows = rel(spark, [("n/c", "x", "calls", "one"), ("n/c", "x", "uses", "one"), ("m/a", "x", "calls", "two")])
    edges = rollup.file_edges(ents, rows)
    assert collected(edges) == [("n/c", "m/a", 2)] and collected(rollup.module_edges(edges)) == [("n", "m", 2)]
    page = rollup.html_page(rollup.module_edges(edges), "<b></script>")
    assert page.count("</script>") == 2 and "&lt;b>" in page


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in {"src/a.py": "x" * 60, "out/b.py": "y" * 60, ".env": "K=1", "src/c.bin": "z", "src/bad.py": "ok"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src/bad.py").write_bytes(b"caf\xe9 " * 20)
    rows = sources.scan(spark, str(tmp_path))
    assert {r["file"] for r in rows.collect()} == {"src/a.py", "src/bad.py"}
    assert {r["file"]: r["text"] for r in sources.indexable_content(rows).collect()}["src/bad.py"] == "caf " * 20
    (tmp_path / "c.toml").write_text('[ignore]\ndirs = ["src"]')
    assert sources.scan(spark, str(tmp_path), sources.ProjectConfig.load(tmp_path / "c.toml")).where("file like 'src/%'").count() == 0
    assert sources.ProjectConfig.load(tmp_path / "none.toml") == sources.ProjectConfig()


def test_cache_encodes_each_text_once(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], "id int, text string")
    cache = vectors.embed(rows.where("id = 3")).select(vectors.cache_key(F.col("text"), "m").alias("hash"), "embedding")
    out, new = vectors.with_cache(rows, cache, "m")
    assert new.count() == 1 and out.where("embedding is null").count() == 0
    assert render.code_results(spark.createDataFrame([(1, "f", 3, "a\nb", 0.5)], "chunk_id int, file string, line_start int, text string, score double")).first()["block"] == "f lines=3-4 score=0.5000\na\nb"


def tree(tmp_path):
    root = tmp_path / "project"
    body = "def login(): pass\n" + "# some text that makes the file long enough to be indexed\n" * 2
    for name in ("src/a.py", "src/b.py", "out/c.py", "gen/d.py", "gen/keep.py", "src/secrets.yaml", "lib/x.min.js", "lib/n.ipynb"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body + name)
    (root / ".gitignore").write_text("# made\ngen/*\n!gen/keep.py\n/out/\n")
    (tmp_path / "secret.py").write_text(body)
    (root / "src" / "leak.py").symlink_to(tmp_path / "secret.py")
    (tmp_path / "elsewhere").mkdir()
    (tmp_path / "elsewhere" / "e.py").write_text(body)
    (root / "linked").symlink_to(tmp_path / "elsewhere")
    return root


def test_scan_keeps_inside_the_project(spark, tmp_path):
    root = str(tree(tmp_path))
    names = lambda **more: [r["file"] for r in sources.scan(spark, root, **more).collect()]
    assert sorted(names()) == ["gen/keep.py", "lib/x.min.js", "src/a.py", "src/b.py"]
    assert names(search=True) == ["gen/keep.py", "lib/n.ipynb", "src/a.py", "src/b.py"]
    assert "src/secrets.yaml" in names(secrets=True)


def test_build_of_a_tree_and_of_one_file(spark, tmp_path):
    import os

    root, shown = tree(tmp_path), []

    def extractor(file, text):
        return {"entities": [{"name": f"f_{file[-4]}", "type": "fn", "tags": "mine"}], "relations": [{"from": f"f_{file[-4]}", "relation": "calls", "to": "other"}]}

    graph = build.GraphStore(spark, f"file://{tmp_path}/graph")
    first = graph.build(str(root), extractor)
    assert first["total_files"] == 5 and first["indexed"] == 5 and first["remaining"] == 0
    files = {r["file"] for r in graph.read().entities.collect()}
    assert "src/secrets.yaml" not in files and {"src/a.py", "src/b.py", "gen/keep.py"} <= files
    assert {r["traits"] for r in graph.read().entities.where("name = 'f_a'").collect()} == {"exported mine"}
    assert graph.build(str(root), extractor)["indexed"] == 0
    (root / "src" / "b.py").unlink()
    os.utime(root / "src" / "a.py", (1, 1))
    again = graph.build(str(root), extractor)
    assert again["indexed"] == 1 and again["deleted"] == 1 and again["total_files"] == 4
    os.utime(root / "src" / "a.py", (2, 2))
    assert graph.index_file(str(root), "src/a.py", lambda file, text: {"entities": [{"name": "new", "type": "class"}]})["indexed"] == 1
    assert {r["name"] for r in graph.read().entities.where("file = 'src/a.py'").collect()} == {"new", "src/a.py"}
    assert graph.read().entities.where("file = 'gen/keep.py'").count() == 2
    assert graph.clear().entities.count() == 0 and graph.read().meta.count() == 0


def test_build_locates_entities_and_applies_rules(spark):
    files = spark.createDataFrame(
        [("a.py", 1, 40, "import os\r\n\r\nasync def load(url):\r\n    yield url\r\n"), ("s.css", 1, 30, ".card, .tile { color: red }" + " " * 20 + "/* x */" * 5), ("x.json", 1, 20, '{"port": 1, /* c */}' + "\n" * 9 + "// the port of the service, and nothing more")],
        "file string, mtime long, length long, text string",
    )
    tell = lambda file, text: {"entities": [{"name": "load", "type": "fn"}]} if file == "a.py" else {}
    graph, counts = build.brought_up_to_date(build.empty(spark), files, tell, rules=True)
    got = {r["name"]: r for r in graph.entities.collect()}
    assert set(got) == {"load", "a.py", ".card", ".tile", "s.css", "port", "x.json"} and counts.first()["remaining"] == 0
    load = got["load"]
    assert (load["line_start"], load["line_end"], load["snippet"]) == (3, 4, "import os\n\nasync def load(url):\n    yield url")
    assert {"async", "exported"} <= set(load["traits"].split())
    assert got["port"]["line_start"] == 1 and ("x.json", "x.json", "defines", "port") in collected(graph.relations)
    # a later build without a place keeps the one that is known
    again = store.upsert_entities(graph.entities, spark.createDataFrame([("a.py", "load", "function", "told", None, None, "", "t")], build.ENTITIES))
    row = again.where("name = 'load'").first()
    assert (row["description"], row["line_start"], row["line_end"], row["snippet"], row["traits"]) == ("told", 3, 4, load["snippet"], "t")


def test_streams_go_on_and_batches_count_once(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame(xs, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    import datetime

    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    rows([(1, 7, "a", 1.0, day(1)), (2, 7, "a", 2.0, day(1, 5)), (3, 8, "b", 4.0, day(2))]).coalesce(1).write.parquet(source)
    assert collected(watch.latest_meta(spark, source, state)) == [(7, 2, 2), (8, 3, 1)]
    rows([(9, 7, "a", 8.0, day(3))]).coalesce(1).write.mode("append").parquet(source)
    assert collected(watch.latest_meta(spark, source, state)) == [(7, 9, 3), (8, 3, 1)]
    assert collected(watch.latest_meta(spark, source, state)) == [(7, 9, 3), (8, 3, 1)]
    done = watch.committed(spark, state)
    assert len(done) == 2
    # a batch that ran, but was not noted as done, runs again
    import shutil

    for i in range(max(done), max(done) + 1):
        for f in (tmp_path / "state" / "offsets" / "commits").glob(f"*{i}*"):
            f.unlink()
    assert collected(watch.latest_meta(spark, source, state)) == [(7, 9, 3), (8, 3, 1)]
    got = collected(watch.tumbling_counts(spark, source))
    assert got == [(day(1), "a", 2, 3.0), (day(2), "b", 1, 4.0), (day(3), "a", 1, 8.0)]
    shutil.rmtree(source)


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodeway.sources.scratch import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")))


def test_map_by_file_and_in_degree(spark):
    listing = spark.createDataFrame([("b", "x", "function x:9", 0.2), ("b", "y", "function y:3", 0.1), ("a", "z", "class z", 0.15)], "file string, name string, line string, score double")
    assert [tuple(r) for r in rank.by_file(listing).collect()] == [("b", 0.2, "  function y:3\n  function x:9"), ("a", 0.15, "  class z")]
    ranked = spark.createDataFrame([("a", "x"), ("a", "y")], "file string, name string")
    links = spark.createDataFrame([("a\nx", "a\ny", 2), ("b\nq", "a\ny", 1)], "src string, dst string, weight long")
    assert collected(rank.in_degree(ranked, links)) == [("a\nx", 0.0), ("a\ny", 3.0)]


def test_embedded_texts_equal_sql_where_signs_cancel(spark, tmp_path):
    """Two tokens of one bucket and opposite signs, a null text, and blank ones."""
    import zlib

    import duckdb

    from lodeway.plans.oracles import ORACLES
    from lodeway.plans.queries import QUERIES

    sides = {}
    for i in range(200):
        h = zlib.crc32(f"w{i}".encode())
        sides.setdefault(h % 64, {})[h >> 16 & 1] = f"w{i}"
    texts = [" ".join(p.values()) for p in sides.values() if len(p) == 2][:6] + [None, "", "  ", "plain words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["embed_documents"](spark, str(tmp_path)).collect())
    assert got == [(i, h, float(n)) for i, h, n in sorted(con.execute(ORACLES["embed_documents"]).fetchall())]


def test_neighbours_of_ties_copies_and_odd_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (300, 5)).astype(float)  # many equal products
    v[7], v[8] = 0.0, v[9]
    v[10:40] = v[10] + r.normal(size=(30, 5)) * 1e-9  # apart in double precision only
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    score = lambda a, b: sum(x * y for x, y in zip(v[a].tolist(), v[b].tolist()))
    want = {(q, n) for q in range(300) for n in sorted((n for n in range(300) if n != q), key=lambda n: (-score(q, n), n))[:4]}
    assert {(x["query"], x["neighbour"]) for x in vectors.neighbours(rows, 4, block=70).collect()} == want
    # a query's partners found so far stay few: what is kept does not grow with the vectors that pass
    best = vectors._Best(np.arange(300), v, 4)
    best.offer_all(np.arange(300), v)
    assert set(zip(*(x.tolist() for x in best.rank()[:2]))) == want and len(best.found[0][0]) == 1200


def test_weaker_relations_go_in_one_exchange(spark):
    rows = rel(spark, [("f", "a", "calls", "b"), ("f", "a", "uses", "b"), ("f", "a", "uses", "b"), ("f", "a", "uses", "c"), ("f", "a", "imports", "b"), (None, "a", "calls", "b"), (None, "a", "uses", "b")])
    got = sanitize.without_weaker(rows)
    assert set(map(tuple, got.collect())) == {("f", "a", "calls", "b"), ("f", "a", "uses", "c"), ("f", "a", "imports", "b"), (None, "a", "calls", "b"), (None, "a", "uses", "b")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
