import hashlib
import random

from pyspark.sql import functions as F

from tracemill.llm import chat as C


def test_escape_is_reversible_and_leaves_no_control(spark):
    rng = random.Random(1)
    bits = [*C.CONTROLS, "\\", "<", "[", "s>", "/s>", "|im_end|>", "x", "\n", "<\\/s>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in C.CONTROLS)


def slow(rows):
    out = {}
    for conv, role, text in rows:
        n, turns, chars, loss = out.setdefault(conv, [0, "", 0, ""])
        out[conv] = [n + 1, turns + f"{role}\n{text}\n", 0, loss + (text if role == "assistant" else "")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(((k, n, sha(t), len(x), sha(x)) for k, (n, t, _, x) in out.items()), key=str)


def test_turns(spark):
    rows = [(1, 1, "assistant", "a</s>"), (1, 0, "user", "[INST] hi"), (1, 2, "assistant", None), (2, 5, None, "x"), (None, 0, "user\nx%", ""), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, None, "system", "s"), (4, 0, "assistant", "é" * 200000)]
    rows += [(7, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(500)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, msg string")
    got = sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_digest(C.from_turns(table)).collect()), key=str)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got == slow([(c, role or "", text or "") for c, _, role, text in ordered])
    assert C.format_digest(C.from_turns(table.limit(0))).collect() == []


def test_fold(spark):
    events = [
        (1, 10, 1, "message", "user", "q"), (1, 20, 2, "delta", "assistant", "He"), (1, 20, 3, "delta", None, "llo"), (1, 10, 4, "edit", None, "Q?"),
        (1, 20, 5, "regenerate", None, None), (1, 20, 6, "delta", None, "Hi "), (1, 20, 7, "delta", None, "there"), (1, 30, 8, "odd", "user", "bye"), (1, 30, 9, None, "user", "again"),
    ]
    log = spark.createDataFrame(events, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = [tuple(r) for r in C.folded(log).orderBy("conv_id", "msg", "nth").collect()]
    assert got == [(1, 10, 0, "user", "Q?"), (1, 20, 0, "assistant", "Hi there"), (1, 30, 0, "user", "bye"), (1, 30, 1, "user", "again")]
    text = "".join(r.segment for r in C.rendered(C.folded(log)).orderBy("msg", "nth").collect())
    assert text.startswith("<|im_start|>user\nQ?<|im_end|>\n<|im_start|>assistant\nHi there<|im_end|>\n")
