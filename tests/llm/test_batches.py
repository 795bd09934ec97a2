import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import common, decontaminate, language, simhash, tokens


def largest(docs):
    """Rows and bytes of the largest batch that a worker is given."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return docs.mapInArrow(run, "n long, size long").agg(F.max("n"), F.max("size")).first()


@pytest.mark.parametrize("stage", ["language", "near", "leaks", "tokens"])
def test_whole_texts_come_in_small_batches(spark, stage, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        if stage == "language":
            language.in_a_language(docs, None)
        elif stage == "near":
            simhash.with_fingerprint(docs, "text", "fp", ["doc_id"])
        elif stage == "leaks":
            decontaminate.contaminated(docs.limit(1), docs.limit(0).withColumnRenamed("doc_id", "item_id"))
        else:
            tokens.write_tokens(docs.limit(0), str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
        rows, size = largest(docs)
        assert rows <= common.TEXT_ROWS and size < 2 * common.TEXT_BYTES
        spark.conf.set(keys[0], "7")
        common.small_batches(spark)
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
