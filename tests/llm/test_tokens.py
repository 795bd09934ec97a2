import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracemill.llm import tokens as T

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello world", "it's 12.5kg\n\n x\ty z ", "a<|endoftext|>b <|startoftext|>", "é ́x ΑΣ ΣΑΣ", "日本 語\r\nÉCOLE !!", "\x1c \x85 a\x1fb", "w " * 30000]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (1, 9), (700, 3), (1000, 10**6), (3000, 3000)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = T.EliasFano.of(values)
        assert ef.all().tolist() == values.tolist()
        assert [ef[i] for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        ef[n]


@pytest.mark.parametrize("image_ids", [T.IMAGE_IDS, 50])
def test_files_hold_whole_texts_in_order(spark, image_ids):
    rng = random.Random(2)
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null id"), (None, None), (5, "same"), (5, "same")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, part string")
    got = T.tokenized(docs, PATH, image_ids=image_ids).orderBy("start").collect()
    plain = Tokenizer.from_file(PATH)
    expected = sorted((i is not None, i or 0, len(e := [*plain.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [x[:2] for x in expected]
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()


def test_encoder_equals_whole_texts():
    rng = random.Random(4)
    bits = ["don't", "'S", "l'été", "..", "x.y", "42", "½", "²", "ª", "µ", "\xa0", "\xad", "\x85", "İ", "ﬁ", "e\u0301", "\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ΣΑΣ", "日本", "🙂", "A", "b", "Ÿ", "ß", "\t", " ", " ", "\n", "\x1c", "!!", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    plain = Tokenizer.from_file(PATH)
    expected = [np.array(e.ids, "<u2").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder = T.Encoder(PATH)
    assert encoder.by_piece
    assert [x for i in range(0, len(texts), 100) for x in encoder(texts[i : i + 100])] == expected
    encoder.by_piece = False
    assert encoder(texts) == expected


def test_empty_table(spark):
    assert T.tokenized(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_what_a_worker_remembers_is_bounded_in_bytes():
    from tracemill.llm import decontaminate as D

    encoder = T.Encoder(PATH)
    texts = [f"{'ab' * 3000}{chr(97 + i)}{chr(97 + j)} word" for i in range(10) for j in range(20)]
    assert encoder(texts) == encoder(texts)
    assert sum(map(len, encoder.known)) < 10_000
    templates = D.Templates()
    for k in range(4):
        templates.read([f"{'xy' * 500_000}{chr(97 + k)}{chr(97 + i)}" for i in range(4)])
    assert sum(map(len, templates.words)) <= D.CHARACTERS_KEPT + 5_000_000
    templates.words.reset()
