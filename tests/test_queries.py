"""Queries against their SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from lodeway.functions import constants as K
from lodeway.operators import analytics
from lodeway.plans.oracles import ORACLES
from lodeway.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "chunk_windows bm25_topk literal_idf hybrid_search knn_per_entity find_usages explain_file affected_files pending_files build_status "
    "filter_by_trait_any subgraph_nodes dead_code test_coverage_summary clone_clusters module_edges file_entity_summary template_tags "
    "snippet_locator traits_detect tag_sanitizer upsert_entities regex_search stream_latest_meta stream_tumbling_counts file_kinds "
    "find_similar_named find_entity_by_name find_entity_by_meaning entity_places find_clones structured_entities"
).split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).count() > 0


def test_dead_code_verified_over_all_sources(spark, duck):
    texts = [t for t, in duck.sql("select text from documents where text is not null").fetchall()]
    names = {w for t in texts for w in re.findall("[a-z]{4,}", t.lower())} - set(K.FRAMEWORK_METHODS)
    alive = set()
    for text in texts:
        for line in text.split("\n"):
            if not line.lstrip(" \t\n\x0b\f\r").startswith(tuple(K.COMMENT_MARKS)):
                declared = {w for p in analytics.DECLARED for w in re.findall(p, line, re.A)}
                alive |= names & set(re.findall(r"[\w$]+", line, re.A)) - declared
    assert {r["name"] for r in QUERIES["dead_code_verified"](spark, FOLDER).collect()} == names - alive
