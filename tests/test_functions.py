import pytest
from pyspark.sql import functions as F

from lodeway.functions import constants as K
from lodeway.functions import text as X
from lodeway.functions.paths import is_inside, resolve_inside


def column(spark, expr, rows):
    return [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths_stay_inside(tmp_path):
    assert resolve_inside(tmp_path, "src/example.py") == (tmp_path / "src/example.py").resolve()
    for bad in ("../outside.py", str(tmp_path.parent / "outside.py")):
        with pytest.raises(ValueError, match="escapes project root"):
            resolve_inside(tmp_path, bad)
    (tmp_path / "root").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "root/escape").symlink_to(tmp_path / "other", target_is_directory=True)
    assert not is_inside(tmp_path / "root", "escape/secret.py") and is_inside(tmp_path / "root", "a/b")


def test_vocabulary_sizes():
    assert len(K.ENTITY_TYPES) == 24 and len(K.TYPE_ALIASES) == 113 and len(K.RELATION_TYPES) == 6 and len(K.LANGUAGES) == 16


def test_tokens(spark):
    got = column(spark, X.tokens, ["getUserName foo_bar a.b-c", "x", " ", "Élan café", "HTTPServer2Go"])
    assert got == [["get", "user", "name", "foo", "bar"], ["x"], [], ["lan", "caf"], ["httpserver2", "go"]]


def test_tags_and_types(spark):
    assert column(spark, X.sanitized_tags, ["A, b  A  c!d", "-x- " + "y" * 40, " ,, "]) == [["a", "b", "c-d"], ["x", "y" * 24], []]
    assert column(spark, X.canonical_type, ["Struct", "fn", "class", "gizmo", " Route "]) == ["class", "function", "class", "symbol", "endpoint"]


def test_paths_by_name(spark):
    paths = ["src/Layout.tsx", "src/Login.tsx", "src/out/x.py", ".env", "env/a.py", "conf/credentials.json", "x/foo.egg-info/a.py", "x/Debug/a.cs", "a.bin"]
    assert column(spark, X.is_ignored, paths) == [False, False, True, False, True, False, True, True, False]
    assert column(spark, X.is_secret, paths) == [False, False, False, True, False, True, False, False, False]
    assert column(spark, X.is_indexable, paths) == [True] * 8 + [False]
    assert column(spark, X.file_kind, [".env.local", "a/b.scss", "Makefile", "x.vue", "README.md", "p.py"]) == ["config", "style", "module", "template", "doc", "module"]
    assert column(spark, X.module_of, ["a/b/c/d/e.py", "a/x.py", "x.py"]) == ["a/b/c", "a", "<root>"]


def test_three_test_predicates(spark):
    paths = ["tests/test_a.py", "pkg/latest.py", "a/__tests__/b.ts", "x.spec.ts", "src/test/A.java", "src/main.py"]
    assert column(spark, X.is_test_path, paths) == [True, True, True, True, True, False]
    assert column(spark, lambda c: c.rlike(K.TEST_FILE), paths) == [True, False, True, True, True, False]
    trait = lambda c: F.array_contains(X.traits(F.lit("n"), F.lit(""), c, F.lit("class")), "test")
    assert column(spark, trait, paths) == [True, False, True, True, True, False]


def test_import_candidates(spark):
    (got,) = column(spark, X.import_candidates, ["src/models/enums.py"])
    assert got == ["src/models/enums.py", "src/models/enums", "./src/models/enums", "./enums", "src.models.enums", "models.enums", "enums"]


def test_query_parts():
    assert X.query_literals("use the foo-bar and fooBar Foo_Bar FOO-BAR getUser ab") == ["foo-bar", "Foo_Bar", "fooBar", "getUser"]
    assert X.query_tokens("getHTTPName foo_bar Foo") == ["getHTTPName", "get", "HTTP", "Name", "foo_bar", "foo", "bar"]


@pytest.mark.parametrize(
    ("file", "snippet", "kind", "name", "want"),
    [
        ("a.py", "async def x():\n  yield 1", "function", "x", "async exported generator"), ("a.py", "@staticmethod\ndef _x", "method", "_x", "static"),
        ("a.ts", "x = input.required<string>()", "property", "x", "input signal"), ("a.ts", "export default abstract class A", "class", "A", "abstract default-export exported"),
        ("a.go", "func Go()", "function", "Go", "exported"), ("a.rs", "pub async fn f()", "function", "f", "async exported"),
        ("a.kt", "  @JvmStatic fun f()", "function", "f", "static"), ("a.cs", "[Obsolete] public static int X", "property", "X", "deprecated"),
        ("a.h", "virtual void f() = 0;", "method", "f", "abstract"), ("b.zz", "async def x", "function", "x", ""),
    ],
)
def test_traits(spark, file, snippet, kind, name, want):
    row = spark.range(1).select(F.array_join(X.traits(F.lit(name), F.lit(snippet), F.lit(file), F.lit(kind)), " ").alias("t")).first()
    assert row["t"] == want


def test_only_the_patterns_of_the_language_are_tried(spark):
    """The plan of a row's traits is one branch a language over one computed snippet, not all patterns of all languages."""
    row = spark.range(1).select(F.lit("n").alias("name"), F.lit("async def x(): yield " + "y" * 400).alias("snip"), F.lit("a.py").alias("file"), F.lit("class").alias("kind"), "id")
    got = row.select(X.traits(F.col("name"), F.col("snip"), F.col("file"), F.col("kind")).alias("t"))
    assert got.first()["t"] == ["async", "exported", "generator"]
    rows = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("function f() {} "), "id").alias("snip"), F.concat(F.lit("f"), "id", F.lit(".zz")).alias("file"))
    plan = rows.select(X.traits(F.col("name"), F.col("snip"), F.col("file"), F.lit("class")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map(") <= 2 and plan.count("element_at") <= 2  # before, the language was worked out for each pattern


def test_tokens_are_extracted_once_a_text(spark):
    """The expression is in a plan once, not in the condition and again in its branch."""
    plan = spark.range(1).select(X.tokens(F.lit("a b").substr(F.lit(1), F.col("id").cast("int"))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
