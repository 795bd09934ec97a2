from tracemill.operators import graph


def test_roll_up_of_a_chain_of_any_depth(spark):
    n = 104
    rows = [(f"s{i}", 1, f"s{i - 1}" if i else None, 1) for i in range(n)] + [("a", 1, "b", 5), ("b", 1, "a", 7)]
    sessions = spark.createDataFrame(rows, "session_id string, project_id long, parent_session_id string, total_tokens long").coalesce(1).cache()
    got = {r.session_id: (r.derived_count, r.total_tokens_rolled) for r in graph.rolled_up(sessions, "total_tokens").collect()}
    assert got == {"s0": (n - 1, n)}
