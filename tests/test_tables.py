"""Changes in place against dictionaries; files of buckets that do not change keep their names."""

import glob
import os
import random

from pyspark.sql import functions as F

from tracemill.operators import tables


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_changes_in_place(spark, tmp_path):
    path, rng = str(tmp_path / "t"), random.Random(4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, scope string, v string, note string")
    content = {k: (k, f"s{k % 7}", rng.choice(["a", None]), f"n{k}" if k % 2 else None) for k in range(300)}
    tables.create(frame(list(content.values())), path, ["k"], buckets=16)
    rows = lambda: {r.k: tuple(r) for r in tables.read(spark, path).collect()}
    assert rows() == content and len({f.split("/")[0] for f in files(path)}) == 16

    # update two rows and insert one: at most three buckets get new files; `note` is only filled
    new = [(3, "s3", "new", "other"), (4, "s4", "new", "filled"), (900, "s9", None, "x")]
    before = files(path)
    done = tables.upsert(path, frame(new), ["k"], preserve=("note",), buckets=16)
    content |= {3: (3, "s3", "new", "n3"), 4: (4, "s4", "new", "filled"), 900: new[2]}
    assert rows() == content and 0 < done["changed"] <= 3
    assert len({f.split("/")[0] for f in before - files(path)}) <= 3
    # again: nothing changes, no file is written
    before = files(path)
    assert tables.upsert(path, frame(new), ["k"], preserve=("note",), buckets=16) == {"changed": 0, "emptied": 0} and files(path) == before

    # replace: the later of two rows of a key stays
    twice = [(5, "s5", "1", None), (5, "s5", "2", None)]
    tables.replace(path, frame(twice), ["k"], F.desc("v"), buckets=16)
    content[5] = twice[1]
    assert rows() == content
    before = files(path)
    tables.replace(path, frame(twice), ["k"], F.desc("v"), buckets=16)
    # insert or ignore leaves what is there
    tables.insert_new(path, frame([(5, "s5", "no", None)]), ["k"], buckets=16)
    assert files(path) == before and rows() == content

    # deleting a scope
    assert tables.delete_scope(path, spark.createDataFrame([("s1",), ("gone",)], "scope string"), ["scope"], ["k"])["changed"] > 0
    content = {k: r for k, r in content.items() if r[1] != "s1"}
    assert rows() == content
    before = files(path)
    assert tables.delete_scope(path, spark.createDataFrame([("s1",)], "scope string"), ["scope"], ["k"]) == {"changed": 0, "emptied": 0} and files(path) == before
    everything = tables.delete_scope(path, spark.createDataFrame([(f"s{i}",) for i in range(10)], "scope string"), ["scope"], ["k"])
    assert everything["emptied"] == everything["changed"] == 16 and files(path) == set()
    assert tables.read(spark, path, like=frame([])).collect() == []
    assert tables.upsert(path, frame([]), ["k"], buckets=16) == {"changed": 0, "emptied": 0}
    tables.upsert(path, frame(new), ["k"], buckets=16)
    assert rows() == {r[0]: r for r in new}
