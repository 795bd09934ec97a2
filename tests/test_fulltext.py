"""The index against the scan, over additions; only the folders of a query's terms are read."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import fulltext, search
from tracemill.plans.views import view

KEYS = ["session_id", "seq"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    messages = view(spark, SF, "messages").select(*KEYS, "content")
    odd = spark.createDataFrame([("x", 0, None), ("x", 1, ""), ("x", 2, "Élan vital: élan, VITAL!"), ("x", 3, "vital elan"), ("x", 4, "the elan of the vital the"), ("x", 5, "日本 語 a_b")], "session_id string, seq long, content string")
    messages = messages.unionByName(odd)
    path = str(tmp_path_factory.mktemp("fts") / "index")
    assert fulltext.add(messages.filter("seq % 3 = 0"), path, KEYS) > 0
    assert fulltext.add(messages.filter("seq % 3 <> 2"), path, KEYS) == messages.filter("seq % 3 = 1").count()
    assert fulltext.add(messages.union(messages), path, KEYS) == messages.filter("seq % 3 = 2").count()
    assert fulltext.add(messages, path, KEYS) == 0
    return messages, path


@pytest.mark.parametrize("query", ["de", "the AND de", "the de", "de OR is", "the NOT de", "NOT the", "NOT the NOT de", "th*", "the th* NOT is", '"elan vital"', '"the elan of the vital"', '"vital the" OR de', "ÉLAN", "nowhere", "nowhere OR de", '"no where"', "", "日本", "a_b", '"in the" de OR NOT e*'])
def test_same_rows_as_the_scan(spark, index, query):
    messages, path = index
    want = sorted(tuple(r) for r in search.search(messages, query).select(*KEYS).collect())
    got = fulltext.search_indexed(messages, path, query, KEYS)
    assert sorted(tuple(r) for r in got.select(*KEYS).collect()) == want
    if query in ("de", "th*", '"elan vital"'):
        assert want


def test_only_folders_of_the_terms_are_read(spark, index):
    _, path = index
    for query in ("de", "th*", '"elan vital"'):
        plan = fulltext.find(spark, path, query, KEYS)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(head#") == plan.count("PushedFilters: [IsNotNull(term)") == (2 if query.startswith('"') else 1)
    read = fulltext._term(fulltext._postings(spark, path), "de").select(F.input_file_name()).distinct().collect()
    assert read and all("/head=d/" in r[0] for r in read)


def test_an_addition_without_its_documents_is_not_seen(spark, index, tmp_path):
    messages, _ = index
    path = str(tmp_path / "i")
    fulltext.add(messages.filter("session_id = 'x'"), path, KEYS)
    lost = spark.createDataFrame([("vital", "x", 9, [0], "dead", "v")], "term string, session_id string, seq long, places array<int>, batch string, head string")
    lost.write.mode("append").partitionBy("batch", "head").parquet(f"{path}/postings")
    assert sorted(r.seq for r in fulltext.find(spark, path, "vital", KEYS).collect()) == [2, 3, 4]
