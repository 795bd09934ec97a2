import pyarrow as pa

from tracemill.llm import language as L


def test_texts_with_letters_stay_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in L.in_a_language(docs, None).collect()} == {1, 4}


def test_the_network_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abc"), (2, "def"), (3, "12")], "doc_id long, text string")
    monkeypatch.setattr(L, "judge", lambda net, texts: [{"abc": ("en", 0.9), "def": ("fr", 0.3)}.get(t, (L.UNKNOWN, 0.0)) for t in texts])
    net = L.ByteNet.__new__(L.ByteNet)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["abc", "def", "12"]})
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f))
    L.in_a_language(docs, net)
    assert [b.column(0).to_pylist() for b in run[0](iter([batch]))] == [[1]]
