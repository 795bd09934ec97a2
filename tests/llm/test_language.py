import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import language as L

WORDS = {"xx": "aba bab abba baab", "yy": "cdc dcd ccdd dcdc", "zz": "éfé fef ffée feéf"}


def rows(n=40):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(WORDS[k].split(), 30)), k) for i, k in enumerate(list(WORDS) * n)]


def test_held_out_accuracy_and_edges(spark):
    edge = [(None, None, "xx"), (9001, "", None), (9002, "12 + 3 !!", "yy"), (9003, "É" * 5, None), (9003, "É" * 5, None), (9004, "aba bab " * 20000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows() + edge], "doc_id long, text string, lang string, score double")
    net = L.fit(docs, ~L.held_out(F.col("doc_id")))
    assert net.labels == ["xx", "yy", "zz"]
    got = L.identify(docs, net).collect()
    truth = {i: k for i, _, k in rows()}
    judged = [(r.lang_pred, truth[r.doc_id]) for r in got if r.doc_id in truth and r.held_out]
    assert len(judged) > 20 and np.mean([a == b for a, b in judged]) > 0.95
    by_id = {r.doc_id: r for r in got if r.doc_id not in truth}
    assert [by_id[i].lang_pred for i in (None, 9001, 9002)] == ["und"] * 3 and by_id[9002].score == 0
    assert by_id[9004].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id == 9003 for r in got) == 2
    kept = L.in_a_language(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.filter("doc_id > 9000").collect()} == {9003, 9004}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(docs, F.lit(True)) is None
    assert [r.lang_pred for r in L.identify(docs, None).collect()] == ["und"]
    assert L.identify(docs.limit(0), None).collect() == []


def test_prediction_does_not_read_other_columns(spark):
    docs = spark.createDataFrame([(1, "aba", "xx")], "doc_id long, text string, lang string")
    net = L.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string"), F.lit(True))
    a = L.identify(docs, net).first()
    b = L.identify(docs.withColumn("lang", F.lit("yy")).withColumn("doc_id", F.lit(5).cast("long")), net).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)
