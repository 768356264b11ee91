"""Registered queries: every operator over the tables that the driver provides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeway.functions import text as X
from lodeway.operators import analytics, build, extract, lexical, lookup, rank, regex, render, rollup, sanitize, store, traverse, vectors
from lodeway.sources import files as sources
from lodeway.sources.adapters import view
from lodeway.sources.scratch import saver, spread
from lodeway.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Arguments that queries and their SQL share.
TEXT_QUERY, LITERAL_QUERY = "and the thorea antion der eaux", "nation re-eaux hehe_st userName"
FILE, NAME, START, HUB_NAME = "app/crm/building/n3.py", "supply_7", "supply_9", "red_widget"
PATTERN, WORD, ABSENT = r"(?:the|and) [a-z]{3,9}ing", "eder", "thorea"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "entities"), view(spark, sf_dir, "relations")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk; its id is the document's."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "source", "doc_id").alias("file"), F.lit(1).alias("line_start"), "text")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("file"), F.col("html").alias("text"))


# chunks and tokens


@query
def chunk_windows(spark, d):
    rows = extract.chunks(view(spark, d, "files"), size=8, overlap=2)
    return rows.select("file", F.col("line_start").cast("long").alias("line_start"), F.md5("text").alias("digest"))


@query
def chunk_fixed(spark, d):
    rows = extract.fixed_chunks(view(spark, d, "files"), size=5)
    return rows.select("file", F.col("line_start").cast("long").alias("line_start"), F.md5("text").alias("digest"))


def doc_index(spark: SparkSession, sf_dir: str) -> lexical.SearchIndex:
    """The search index of all documents, built where none of the same files is there."""
    files = read(spark, sf_dir, "documents").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("length"))
    return lexical.index_of(doc_chunks(spark, sf_dir), "documents", lexical.fingerprint(files.distinct()))


@query
def tokenize_terms(spark, d):
    return doc_index(spark, d).terms.select("term", "df", "tf")


# search


@query
def bm25_topk(spark, d):
    rows = lexical.top(lexical.bm25(doc_index(spark, d), TEXT_QUERY), "bm25", 20)
    return rows.select("chunk_id", F.round("bm25", 5).alias("bm25"))


@query
def literal_idf(spark, d):
    rows = lexical.literal_weights(doc_chunks(spark, d), X.query_literals(LITERAL_QUERY))
    return rows.select("literal", "df", F.round("idf", 6).alias("idf"))


def _dense(spark, d):
    v = read(spark, d, "embeddings")
    q = v.where("vec_id = 0").select("embedding").first()["embedding"]
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding"), q


@query
def dense_topk(spark, d):
    v, q = _dense(spark, d)
    return vectors.nearest(v, q, 20, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))


@query
def hybrid_search(spark, d):
    v, q = _dense(spark, d)
    dense = v.select("chunk_id", vectors.similarity(F.col("embedding"), F.array(*map(F.lit, q))).alias("dense"))
    dense = dense.join(doc_chunks(spark, d).select("chunk_id"), "chunk_id", "left_semi")
    rows = lexical.hybrid(doc_index(spark, d), dense, TEXT_QUERY + " re-eaux", first=30, final=10)
    return rows.select("chunk_id", "file", F.round("score", 5).alias("score"))


@query
def hybrid_search_reranked(spark, d):
    """Rows only: the reranker is a plug-in; here it counts shared words."""
    v, q = _dense(spark, d)
    dense = v.select("chunk_id", vectors.similarity(F.col("embedding"), F.array(*map(F.lit, q))).alias("dense"))
    shared = lambda ask, texts: [len(set(ask.split()) & set(t.split())) / 10 for t in texts]
    return lexical.hybrid(doc_index(spark, d), dense, LITERAL_QUERY + " " + TEXT_QUERY, 30, 10, shared).select("chunk_id", "score")


@query
def search_report(spark, d):
    """Rows only: ranked chunks as text blocks."""
    rows = lexical.top(doc_chunks(spark, d).join(lexical.bm25(doc_index(spark, d), TEXT_QUERY), "chunk_id").withColumnRenamed("bm25", "score"), "score", 8)
    return render.code_results(rows, 300)


@query
def knn_per_entity(spark, d):
    rows = vectors.neighbours(read(spark, d, "embeddings"), 3)
    return rows.select("query", "neighbour", F.round("score", 6).alias("score"))


def _vec_entities(spark, d):
    v = read(spark, d, "embeddings")
    name = F.concat(F.lit("E"), F.col("vec_id") % 97)
    kind = F.when(F.col("label") % 3 == 0, "class").when(F.col("label") % 3 == 1, "function").otherwise("variable")
    return v.select("vec_id", name.alias("name"), kind.alias("type"))


def _placed_vectors(spark, d):
    """An entity for each vector, of which some hundred share a name."""
    said = F.when(F.col("vec_id") % 2 == 0, "Extracted from a file").otherwise("Referenced")
    place = F.concat(F.lit("v/f"), F.col("vec_id") % 50, F.lit(".py"))
    line = F.when(F.col("vec_id") % 5 != 0, F.col("vec_id")).cast("long")
    return _vec_entities(spark, d).select("vec_id", place.alias("file"), "name", "type", said.alias("description"), line.alias("line_start"))


@query
def find_similar(spark, d):
    rows = vectors.find_similar(read(spark, d, "embeddings"), _vec_entities(spark, d), 5, limit=10, least=0.1, types=["class", "function"])
    return rows.select("vec_id", "name", "type", F.round("score", 6).alias("score"))


@query
def embedding_cache(spark, d):
    """Texts by cache key, each encoded once."""
    rows = read(spark, d, "documents").select("doc_id", vectors.cache_key(F.col("text"), "hashed-64").alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query
def embed_documents(spark, d):
    """Rows only: hashed embeddings through the cache, half of which is there."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    half = vectors.embed(docs.where("doc_id % 2 = 0")).select(vectors.cache_key(F.col("text"), "m").alias("hash"), "embedding").dropDuplicates(["hash"])
    rows, _ = vectors.with_cache(docs, half, "m")
    return rows.select("doc_id", "hash", F.round(vectors.similarity(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query
def find_similar_named(spark, d):
    v = read(spark, d, "embeddings")
    rows = vectors.similar_to(v, _placed_vectors(spark, d), "E5", limit=10, least=0.1)
    return rows.select("file", "name", "type", F.round("score", 6).alias("score"))


# lookups


@query
def find_usages(spark, d):
    return lookup.find_usages(graph(spark, d)[1], NAME)


@query
def get_callers(spark, d):
    return lookup.get_callers(graph(spark, d)[1], NAME)


@query
def file_deps(spark, d):
    return lookup.file_deps(graph(spark, d)[1], FILE)


@query
def file_entities(spark, d):
    return lookup.file_entities(graph(spark, d)[0], FILE)


@query
def explain_file(spark, d):
    return lookup.used_by(*graph(spark, d), FILE)


@query
def explain_file_full(spark, d):
    return lookup.explain(*graph(spark, d), FILE)


@query
def affected_files(spark, d):
    return lookup.affected_files(*graph(spark, d), "svc/supply/n7.ts")


@query
def graph_stats(spark, d):
    cache = read(spark, d, "documents").select(vectors.cache_key(F.col("text"), "m").alias("hash")).distinct()
    return lookup.stats(*graph(spark, d), view(spark, d, "file_meta"), cache)


@query
def search_entity_tokens(spark, d):
    return lookup.search_entity(graph(spark, d)[0], "red_bolt", limit=15).select("file", "name", "type", F.col("hits").cast("long").alias("hits"))


def _named_vectors(spark, d):
    v, q = _dense(spark, d)
    return v.select(F.concat(F.lit("Customer"), F.col("chunk_id")).alias("name"), "embedding"), lambda text: q


@query
def list_entities(spark, d):
    return lookup.search_entity(graph(spark, d)[0], "", kind="function", limit=25).select("file", "name", "type")


@query
def find_entity_by_name(spark, d):
    """Names of a token, those of near vectors first."""
    v, encode = _named_vectors(spark, d)
    return lookup.find_entity(graph(spark, d)[0], "Customer 7", embeddings=v, encode=encode)


@query
def find_entity_by_meaning(spark, d):
    """No name fits, but those of near vectors do."""
    v, encode = _named_vectors(spark, d)
    return lookup.find_entity(graph(spark, d)[0], "qqzz", embeddings=v, encode=encode)


@query
def find_entity_in_texts(spark, d):
    """Neither a name nor a vector fits, but lines of files do."""
    return lookup.find_entity(graph(spark, d)[0], ABSENT, files=view(spark, d, "files"))


@query
def entity_places(spark, d):
    files = view(spark, d, "files")
    names = files.select("file", F.lit("pkg.the").alias("name"), F.when(F.endswith("file", F.lit(".en")), F.lit(3)).cast("long").alias("line_start"))
    rows = lookup.with_places(names, files)
    return rows.select("file", "name", "line_start", "line_end", F.md5("snippet").alias("snippet"))


@query
def pending_files(spark, d):
    return lookup.pending(view(spark, d, "disk"), view(spark, d, "file_meta"))


@query
def build_status(spark, d):
    return lookup.build_status(view(spark, d, "disk"), view(spark, d, "file_meta"))


@query
def schema_listing(spark, d):
    return lookup.schema(spark)


@query
def filter_by_trait_all(spark, d):
    return analytics.by_trait(graph(spark, d)[0], ["async", "test"], "all")


@query
def filter_by_trait_any(spark, d):
    return analytics.by_trait(graph(spark, d)[0], ["Exported", "test"], "any", types=["class", "function"], part="supply")


@query
def resolve_candidates(spark, d):
    rows = graph(spark, d)[0].select("file").distinct()
    return rows.select("file", F.explode(X.import_candidates(F.col("file"))).alias("candidate"))


@query
def file_kinds(spark, d):
    """File kind, module, secret, ignored, test and indexable marks of paths made of the tables."""
    ends = F.array(*map(F.lit, ["x.py", ".env", "style.scss", "a.html", "conf.yaml", "README.md", "id_rsa", "test_x.py", "x.spec.ts", "Makefile"]))
    head = F.when(F.col("n_nationkey") % 3 == 0, "build/").when(F.col("n_nationkey") % 3 == 1, "src/tests/").otherwise("src/latest/")
    rows = read(spark, d, "nation").select(F.concat(head, F.lower("n_name"), F.lit("/")).alias("head"), F.explode(ends).alias("end"))
    rows = rows.select(F.concat("head", "end").alias("file"))
    p = F.col("file")
    return rows.select("file", X.file_kind(p).alias("kind"), X.module_of(p, 2).alias("module"), X.is_secret(p).alias("secret"), X.is_ignored(p).alias("ignored"), X.is_test_path(p).alias("test"), X.is_indexable(p).alias("indexable"))


# traversal and ranking


@query
def subgraph_edges(spark, d):
    return traverse.subgraph(*graph(spark, d), START, depth=1, cap=20)[0]


@query
def subgraph_nodes(spark, d):
    rows = traverse.subgraph(*graph(spark, d), START, depth=1, cap=20)[1]
    return rows.select("name", F.col("hop").cast("long").alias("hop"), "state")


@query
def hub_names(spark, d):
    return traverse.fanout(graph(spark, d)[0]).where("files >= 10")


@query
def pagerank(spark, d):
    save = saver(spark)
    entities, relations = map(save, graph(spark, d))
    ranked = save(rank.nodes(entities, relations))
    scores = rank.pagerank(ranked, rank.edges(ranked, entities, relations), ["svc/"], [NAME])
    return scores.select("node", F.round(F.col("score") * 1e6, 3).alias("score"))


@query
def repo_map(spark, d):
    """Rows only: the greedy listing depends on what fits."""
    save = saver(spark)
    entities, relations = map(save, graph(spark, d))
    ranked = save(rank.nodes(entities, relations))
    scores = rank.pagerank(ranked, rank.edges(ranked, entities, relations))
    return rank.budgeted(ranked, scores, tokens=500)


# analytics


@query
def dead_code(spark, d):
    return analytics.dead_code(*graph(spark, d), exclude=["app/crm/machinery/*"])


@query
def dead_code_verified(spark, d):
    """Candidates that the texts of documents mention are alive."""
    words = read(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("name"))
    files = view(spark, d, "files")
    rows = words.distinct().select(F.lit("lib/x.py").alias("file"), "name", F.lit("function").alias("type"), F.lit("").alias("description"), F.lit(1).cast("long").alias("line_start"), F.lit("").alias("traits"))
    none = graph(spark, d)[1].limit(0)
    return analytics.dead_code(rows, none, files=files).select("name")


@query
def test_coverage_summary(spark, d):
    return analytics.coverage_summary(*graph(spark, d))


@query
def test_coverage_uncovered(spark, d):
    return analytics.uncovered(*graph(spark, d))


@query
def test_coverage_entity(spark, d):
    return analytics.tests_of(graph(spark, d)[1], "Customer7")


def _clone_pairs(spark, d):
    v = read(spark, d, "embeddings")
    signs = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.concat(i.cast("string"), F.when(x > 0, "+").otherwise("-")))
    near = vectors.neighbours(v, 20)
    return analytics.clone_pairs(near, v.select(F.col("vec_id").alias("id"), signs.alias("shape")), 0.3, 0.3)


@query
def clone_pairs(spark, d):
    return _clone_pairs(spark, d).select("a", "b", F.round("score", 5).alias("score"), F.round("overlap", 5).alias("overlap"))


@query
def clone_clusters(spark, d):
    rows = analytics.clusters(saver(spark)(_clone_pairs(spark, d)), save=saver(spark))
    return rows.select("component", "members", F.round("avg_score", 3).alias("avg_score"), F.round("avg_overlap", 3).alias("avg_overlap"), "n_pairs")


@query
def find_clones(spark, d):
    """Typed definitions alike in vectors and in the signs of their first components, as ranked clusters."""
    v, entities = read(spark, d, "embeddings"), _placed_vectors(spark, d)
    signs = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.concat(i.cast("string"), F.when(x > 0, "+").otherwise("-")))
    relations = entities.join(v.select("vec_id", F.explode(signs).alias("to_name")), "vec_id").select("file", F.col("name").alias("from_name"), F.lit("calls").alias("relation"), "to_name")
    rows = analytics.find_clones(entities, relations, v, least=0.3, overlap=0.3)
    member = F.transform("members", lambda m: F.concat_ws(":", m["file"], m["line_start"].cast("string"), m["name"], m["type"]))
    return rows.select(F.round("avg_score", 3).alias("avg_score"), F.round("avg_overlap", 3).alias("avg_overlap"), "n_pairs", F.array_join(member, ",").alias("members"))


@query
def exact_clones(spark, d):
    rows = read(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return rows.where("n > 1")


# roll-ups


@query
def file_edges(spark, d):
    return rollup.file_edges(*graph(spark, d))


@query
def module_edges(spark, d):
    return rollup.module_edges(rollup.file_edges(*graph(spark, d)), 2)


@query
def file_entity_summary(spark, d):
    return rollup.file_summary(graph(spark, d)[0], 5)


@query
def connected_files(spark, d):
    rows = rollup.connected_files(rollup.file_edges(*graph(spark, d)), 2, 5)
    return rows.select("module", "file", "conn", F.col("rank").cast("long").alias("rank"))


# extraction and cleaning


@query
def template_tags(spark, d):
    return extract.template_tags(page_files(spark, d))


@query
def template_selectors(spark, d):
    return extract.template_selectors(page_files(spark, d))


@query
def template_references(spark, d):
    text = F.concat(F.lit('<li (click)="save(item'), F.col("n_nationkey"), F.lit(')" *ngIf="count() && ready">{{ user.'), F.lower("n_name"), F.lit("() }}</li>"))
    return extract.template_references(read(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(".html")).alias("file"), text.alias("text")))


@query
def stylesheet_selectors(spark, d):
    text = F.concat(F.lit("@import 'base.css'; .n"), F.col("n_nationkey"), F.lit(", a:hover { --w-"), F.col("n_regionkey"), F.lit(": 1px; } @media x { .n"), F.col("n_nationkey"), F.lit(" { color: red } }"))
    rows = extract.stylesheet(read(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(".css")).alias("file"), text.alias("text")))
    return rows.select("file", "name", "type", "relation")


def _css_files(spark, d):
    text = F.concat(F.lit(".n"), F.col("n_nationkey"), F.lit(" { --w-"), F.col("n_regionkey"), F.lit(": 1px; } @import 'base.css';"))
    return read(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(".css")).alias("file"), text.alias("text"))


def _structured_files(spark, d):
    props = spread(read(spark, d, "events")).select(F.concat(F.lit("e"), F.col("event_id"), F.lit(".json")).alias("file"), F.col("props").alias("text"))
    code = view(spark, d, "files")
    return page_files(spark, d).unionByName(_css_files(spark, d)).unionByName(props).unionByName(code)


@query
def structured_entities(spark, d):
    """What rules find in pages, stylesheets and configurations; other files are not for them."""
    return extract.structured(_structured_files(spark, d))[0]


@query
def structured_relations(spark, d):
    rows = extract.structured(_structured_files(spark, d).where(~F.endswith("file", F.lit(".html"))))[1]
    return rows.groupBy("file", "relation").agg(F.count("*").alias("n"), F.max("to_name").alias("last"))


@query
def config_keys(spark, d):
    rows = read(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id"), F.lit(".json")).alias("file"), F.col("props").alias("text"))
    return extract.config_keys(rows).groupBy("name").agg(F.count("*").alias("n"))


@query
def config_lines(spark, d):
    """Keys of texts that do not parse: documents with the first word of a line made a key."""
    files = read(spark, d, "documents").select(F.concat("doc_id", F.lit(".yaml")).alias("file"), F.regexp_replace("text", r"(?m)^([A-Za-z]{4})[a-z]* ", "$1: ").alias("text"))
    return extract.config_keys(files).groupBy("name").agg(F.count("*").alias("n"))


@query
def snippet_locator(spark, d):
    files = view(spark, d, "files")
    names = files.select("file", F.explode(F.array(F.lit("der"), F.lit("pkg.the"), F.lit("zzzz"))).alias("name"))
    rows = extract.locate(names, files)
    return rows.select("file", "name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def _snippets(spark, d):
    base = F.element_at(
        F.array(*map(F.lit, ["async def x(): yield 1", "export default class A {}", "@Input() x = input(1)", "pub async fn go() {}", "// deprecated", "static int a = 0;", "public abstract class B", ""])),
        (F.col("p_partkey") % 8 + 1).cast("int"),
    )
    end = F.element_at(F.array(*map(F.lit, [".py", ".ts", ".tsx", ".rs", ".go", ".java", "_test.go", ".c", ".zz"])), (F.col("p_partkey") % 9 + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("class")
    return spread(read(spark, d, "part")).select("p_partkey", F.initcap(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), base.alias("snippet"), F.concat(F.lit("x/f"), F.col("p_partkey"), end).alias("file"), kind.alias("type"))


@query
def traits_detect(spark, d):
    rows = _snippets(spark, d)
    return rows.select("p_partkey", F.array_join(X.traits(F.col("name"), F.col("snippet"), F.col("file"), F.col("type")), " ").alias("traits"))


@query
def tag_sanitizer(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(X.sanitized_tags(F.concat_ws(", ", "p_name", "p_brand", "p_type", F.lit("A B C"))), ",").alias("tags"))


@query
def entity_types(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(
        X.canonical_type(F.concat(F.lit(" "), F.upper("event_type"))).alias("type"), "event_type", "n"
    )


@query
def sanitize_entities(spark, d):
    rows = view(spark, d, "entities")
    raw = rows.select("file", F.when(F.col("line_start") % 7 == 0, F.concat("name", F.lit(".py"))).otherwise(F.col("name")).alias("name"), F.when(F.col("line_start") % 5 == 0, "struct").when(F.col("line_start") % 5 == 1, "Gizmo").otherwise(F.col("type")).alias("type"), "description", F.col("traits").alias("tags"))
    out = sanitize.entities(raw)
    return out.select("file", "name", "type", F.array_join("tags", ",").alias("tags"))


@query
def sanitize_relations(spark, d):
    entities, relations = map(saver(spark), graph(spark, d))
    return sanitize.relations(relations, entities.where("type != 'function'")).groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("to_name").alias("names"))


@query
def dedupe_calls_uses(spark, d):
    rows = graph(spark, d)[1]
    more = rows.unionByName(rows.where("relation = 'calls' and to_name like '%1'").withColumn("relation", F.lit("uses")))
    return sanitize.without_weaker(more).groupBy("file", "relation").agg(F.count("*").alias("n"))


@query
def entity_texts(spark, d):
    """What each entity is embedded as."""
    rows = vectors.entity_texts(*graph(spark, d))
    return rows.select("file", "name", "type", F.md5("text").alias("digest"))


# writes


@query
def upsert_entities(spark, d):
    old = view(spark, d, "entities")
    new = old.where("line_start % 2 = 0").select("file", "name", "type", F.when(F.col("line_start") % 4 == 0, "").otherwise("new").alias("description"), F.when(F.col("line_start") % 8 != 0, F.col("line_start") + 1).alias("line_start"), F.lit("fresh").alias("traits"))
    extra = old.where("line_start % 3 = 0").select("file", F.concat("name", F.lit("_b")).alias("name"), "type", "description", "line_start", "traits")
    return store.upsert_entities(old, new.unionByName(extra))


@query
def add_relations(spark, d):
    rows = graph(spark, d)[1].where("relation = 'calls'")
    new = rows.where("to_name like '%3'").unionByName(rows.where("to_name like '%4'").withColumn("to_name", F.concat("to_name", F.lit("x"))))
    return store.add_relations(rows, new).groupBy("added").agg(F.count("*").alias("n"))


@query
def cleanup_deleted(spark, d):
    return store.cleaned(view(spark, d, "file_meta"), view(spark, d, "disk"))


@query
def delete_file_data(spark, d):
    entities, _ = graph(spark, d)
    return store.delete_files(entities, entities.where("type = 'function'")).groupBy("file").agg(F.count("*").alias("n"))


@query
def mark_stale_cascade(spark, d):
    entities, relations = graph(spark, d)
    meta = entities.select("file").distinct().withColumn("mtime", F.length("file").cast("long"))
    return store.mark_stale(meta, entities, relations, "svc/supply/n7.ts")


@query
def write_batch_status(spark, d):
    entities, relations = graph(spark, d)
    batch = entities.groupBy("file").agg(F.count("*").alias("n_entities")).join(relations.where("relation != 'defines'").groupBy("file").agg(F.count("*").alias("n_relations")), "file", "left")
    batch = batch.select("file", "n_entities", F.coalesce("n_relations", F.lit(0)).alias("n_relations"), F.lit(False).alias("module_only"), F.lit(False).alias("completes"))
    disk = entities.where("file not like '%7.ts'").select("file")
    return store.batch_status(batch, disk)


@query
def backfill_traits(spark, d):
    return store.backfilled(_snippets(spark, d)).where("traits != ''").groupBy("traits").agg(F.count("*").alias("n"))


def _sources(spark, d):
    """Documents as source files of two moments, and an extractor that knows one function of most."""
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", F.concat("doc_id", F.lit(".py"))).alias("file"), F.col("doc_id").alias("mtime"), F.octet_length("text").cast("long").alias("length"), "text", "doc_id")
    first = docs.where("doc_id % 3 != 0").drop("doc_id")
    mtime = F.when(F.col("doc_id") % 4 == 0, F.col("mtime") + 1_000_000).otherwise(F.col("mtime"))
    second = docs.where("doc_id % 5 != 0").withColumn("mtime", mtime).drop("doc_id")

    def one(file, text):
        n = int(file.rpartition("/")[2][:-3])
        if n % 11 == 0:
            return {}
        return {"entities": [{"name": f"f{n}", "type": "fn"}], "relations": [{"from": f"f{n}", "relation": "calls", "to": f"f{n % 7}"}]}

    return first, second, one


@query
def build_graph(spark, d):
    first, _, one = _sources(spark, d)
    return build.brought_up_to_date(build.empty(spark), first, one)[1]


@query
def build_incremental(spark, d):
    """The counts of a second build, after files came, went and changed."""
    first, second, one = _sources(spark, d)
    return build.brought_up_to_date(build.brought_up_to_date(build.empty(spark), first, one)[0], second, one)[1]


def _written(spark, d):
    entities, relations = map(saver(spark), graph(spark, d))
    meta = entities.select("file").distinct().select("file", F.lit(1).cast("long").alias("mtime"), F.lit(True).alias("incoming_done"))
    offered = relations.where("relation != 'defines'")
    batch = entities.groupBy("file").agg(F.count("*").alias("n_entities")).join(offered.groupBy("file").agg(F.count("*").alias("n_relations")), "file", "left")
    batch = batch.select("file", "n_entities", F.coalesce("n_relations", F.lit(0)).alias("n_relations"), F.lit(False).alias("module_only"), F.lit(False).alias("completes"))
    disk = entities.where("file not like '%7.ts'").select("file", F.lit(2).cast("long").alias("mtime")).distinct()
    new = entities.where("type != 'module'").withColumn("name", F.concat("name", F.lit("_2")))
    return store.write_batch(store.Graph(entities, relations, meta), batch, new, offered.withColumn("from_name", F.concat("from_name", F.lit("_2"))), disk)


@query
def write_batch_report(spark, d):
    return _written(spark, d)[1]


@query
def write_batch_graph(spark, d):
    """Files, entities, relations and files that need incoming references after a batch."""
    g, _ = _written(spark, d)
    ent = g.entities.groupBy("file").agg(F.count("*").alias("n_entities"))
    edges = g.relations.groupBy("file").agg(F.count("*").alias("n_relations"))
    return g.meta.join(ent, "file", "full").join(edges, "file", "full").select("file", "mtime", "incoming_done", "n_entities", "n_relations")


@query
def add_entity(spark, d):
    entities, relations = graph(spark, d)
    g = store.Graph(entities, relations, view(spark, d, "file_meta").select("file", "mtime", "incoming_done"))
    g = store.add_entity(g, "src/u1.py", "Extra", "struct", 77, "added", ["Fresh", "x y"])
    return g.entities.where("file = 'src/u1.py'").join(g.meta, "file").join(g.relations.where("file = 'src/u1.py'").groupBy("file").agg(F.count("*").alias("n_relations")), "file")


@query
def mark_files_seen(spark, d):
    return store.mark_seen(view(spark, d, "file_meta"), view(spark, d, "disk"))


@query
def cache_hit_rate(spark, d):
    rows = read(spark, d, "documents").select(vectors.cache_key(F.col("text"), "m").alias("hash"), "doc_id")
    return store.cache_hit_rate(rows, rows.where("doc_id % 3 = 0"))


@query
def trait_union(spark, d):
    rows = _snippets(spark, d)
    united = X.united_traits(X.traits(F.col("name"), F.col("snippet"), F.col("file"), F.col("type")), X.sanitized_tags(F.lit("async, Mine")))
    return rows.select("p_partkey", united.alias("traits"))


@query
def in_degree_rank(spark, d):
    entities, relations = graph(spark, d)
    ranked = rank.nodes(entities, relations)
    return rank.in_degree(ranked, rank.edges(ranked, entities, relations))


@query
def repo_map_by_file(spark, d):
    """Rows only: as the listing, but ranked by references."""
    save = saver(spark)
    entities, relations = map(save, graph(spark, d))
    ranked = save(rank.nodes(entities, relations))
    return rank.by_file(rank.budgeted(ranked, rank.in_degree(ranked, rank.edges(ranked, entities, relations)), tokens=500))


@query
def extractor_payload(spark, d):
    """Rows only: a plugged-in extractor that names a file's first word."""
    first = lambda file, text: {"entities": [{"name": text.split()[0], "type": "doc"}], "relations": [{"from": file, "relation": "defines", "to": text.split()[0]}]}
    rows = sources.extract_with(view(spark, d, "files"), first)
    return rows.select("file", F.get("entities", 0)["name"].alias("name"), F.size("relations").alias("n_relations"))


# regex


@query
def regex_search(spark, d):
    rows = regex.search(view(spark, d, "files"), PATTERN, limit=None)
    return rows.select("file", F.col("line").cast("long").alias("line"), "match")


@query
def raw_occurrences(spark, d):
    rows = regex.raw_occurrences(view(spark, d, "files"), WORD)
    return rows.select("file", F.col("line").cast("long").alias("line"), F.md5("context").alias("context"))


@query
def structural_search(spark, d):
    """Rows only: metavariables over pages' scripts."""
    return regex.structural(page_files(spark, d), "track($A)", limit=None).select("file", "line", "match")


# memory and streams


@query
def memory_listing(spark, d):
    """Rows only."""
    return render.memory_listing(read(spark, d, "conversations"))


@query
def entity_blocks(spark, d):
    """Entities as text blocks."""
    rows = graph(spark, d)[0].where(F.col("file") == FILE)
    rows = rows.withColumn("line_end", F.when(F.col("line_start") % 2 == 0, F.col("line_start") + 3).otherwise(F.col("line_start")))
    return render.entity_results(rows.withColumn("snippet", F.when(F.col("line_start") % 3 == 0, F.concat(F.lit("def "), F.col("name"), F.lit("\r\n  pass"))))).select("name", "block")


@query
def relation_lines(spark, d):
    return render.relation_lines(graph(spark, d)[1].where(F.col("file") == FILE)).select("from_name", "relation", "line")


@query
def relation_section(spark, d):
    rows = render.relation_lines(graph(spark, d)[1].where((F.col("file") == FILE) & (F.col("relation") == "imports")), "")
    return render.section(rows, "Imports", "line", "from_name")


@query
def scored_notes(spark, d):
    return render.scored_notes(read(spark, d, "conversations").withColumn("score", F.length("role") / 7))


@query
def stream_latest_meta(spark, d):
    return watch.latest_meta(spark, f"{d}/events.parquet").select("file", "mtime", "n")


@query
def stream_tumbling_counts(spark, d):
    return watch.tumbling_counts(spark, f"{d}/events.parquet").select("start", "event_type", "n", F.round("total", 2).alias("total"))
