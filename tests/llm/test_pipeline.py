"""The pipeline end to end; each stage against plain Python on its own input."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tracemill.llm import mixing, simhash

ITEM = "which of the two old farmers carried more baskets of ripe red fruit to the market near the quiet harbour before noon on that day"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __t string, __fp long, __id long, __row long, __bad int, __source string, fp_of_row int, row_of_text int"


def words(rng, tongue, n):
    parts = {"en": ["the", "ing", "er", "th", "on", "and"], "fr": ["que", "le", "ou", "eau", "re", "é"]}[tongue]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        rows.append((i, words(rng, lang, rng.randint(30, 120)), lang, f"s{i % 4}"))
    rows += [(200, rows[5][1], "fr", "s1"), (200, rows[5][1], "fr", "s1"), (201, words(rng, "en", 20) + " " + ITEM + " " + words(rng, "en", 20), "en", None), (202, None, None, "s1"), (203, "", "en", None), (204, "12 34 !", "en", "s2"), (205, words(rng, "en", 30_000), "en", "s0"), (None, words(rng, "fr", 50), "fr", "s3")]
    path = tmp_path_factory.mktemp("sf")
    full = [(*r, len(r[1] or ""), "t", 1, 2, 3, 4, "x", 5, 6) for r in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == before.columns
    start = {tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    lettered = [r for r in start if any(map(str.isalpha, r[1] or ""))]
    assert {tuple(r) for r in kept["language_id"]} == set(lettered) and len(kept["language_id"]) == len(lettered) + 1
    # near-duplicates: components by brute force over fingerprints
    prints = [(simhash.fingerprint(r.text.encode()), r) for r in kept["language_id"]]
    groups = []
    for fp, r in prints:
        mine = [g for g in groups if any((fp ^ other).bit_count() <= 4 for other, _ in g)]
        groups = [g for g in groups if g not in mine] + [[(fp, r), *[x for g in mine for x in g]]]
    smallest = lambda g: min((x.doc_id is None, x.doc_id or 0) for _, x in g)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept["near_dedup"]) == sorted(map(smallest, groups))
    assert {tuple(r) for r in kept["near_dedup"]} <= {tuple(r) for r in kept["language_id"]}
    assert {tuple(r) for r in kept["decontamination"]} == {tuple(r) for r in kept["near_dedup"] if ITEM not in r.text}
    # the mix: whole documents, each as often as it is taken, at most twice (its copies may be cut only in the report)
    mixed, once = [tuple(r) for r in kept["source_mixing"]], {tuple(r) for r in kept["decontamination"]}
    assert set(mixed) <= once and max(map(mixed.count, mixed)) <= mixing.MOST
    # tokens
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(P.VOCABULARY)))
    assert len(kept["token_output"]) == len(mixed)
    want = sorted((r[0] is None, r[0] or 0, [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in mixed)
    got = sorted(kept["token_output"], key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((n, i, len(ids), crc(ids)) for n, i, ids in want)


def test_run_and_empty_documents(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 50
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
