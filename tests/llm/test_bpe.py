import hashlib
import random
from functools import cache

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@cache
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.ranks(PATH), special_tokens={})


@cache
def encoder():
    return B.Encoder(B.ranks(PATH), PATTERN)


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def small_vocabulary(seed):
    """Merges over three letters, so that nearly all pairs compete."""
    rng = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)]
    have = [b"a", b"b", b"c"]
    while len(tokens) < 286:
        new = rng.choice(have) + rng.choice(have)
        if len(new) <= 9 and new not in tokens:
            tokens.append(new)
            have.append(new)
    return {t: i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("seed", range(40))
def test_transducer_equals_merges_on_competing_pairs(seed):
    machine = B.Transducer(small_vocabulary(seed))
    rng = random.Random(1000 + seed)
    for _ in range(150):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60)))
        assert ids(machine(data)) == [machine.ids[t] for t in machine.merged(data)]
    for left, token in rng.sample([(a, b) for a in machine.ids for b in machine.ids if len(a + b) > 2], 300):
        if machine.merged(left) == [left] and machine.merged(token) == [token]:
            assert machine._stands(left, token) == (machine.merged(left + token) == [left, token])


def test_lookahead_is_bounded_and_tokens_come_out_early():
    machine = B.Transducer(B.ranks(PATH))
    longest = max(map(len, machine.ids))
    token = {i: t for t, i in machine.ids.items()}
    given_out = 0
    for n, (state, out) in enumerate(machine.steps(("internationalisation" * 400).encode()), 1):
        given_out += sum(len(token[i]) for i in ids(out))
        assert n - given_out == len(machine.states[state][1]) <= 2 * longest
    assert len(machine.states) < 500


def test_moves_are_dropped_without_changing_results():
    machine, small = B.Transducer(B.ranks(PATH)), B.Transducer(B.ranks(PATH), moves_kept=20)
    for word in ("unbelievable", "zusammengehörigkeit", "déjà-vu", "qqqqxzx" * 20) * 2:
        assert small(word.encode()) == machine(word.encode())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids(encoder().encode(text)) == plain().encode_ordinary(text)
    assert "".join(B.Decoder(B.ranks(PATH)).stream(plain().encode_ordinary(text))) == text


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_texts(text):
    assert ids(encoder().encode(text)) == plain().encode_ordinary(text)
    assert B.PATTERN == PATTERN


def test_code_points_of_any_version_of_unicode():
    for lead in range(0, 0x110000, 61):
        if not 0xD800 <= lead < 0xE000:
            c = chr(lead)
            text = f"a{c}a  {c}{c} 1{c} {c}1"
            assert ids(encoder().encode(text)) == plain().encode_ordinary(text), hex(lead)
    for odd in ("՘", "\U00016ea7", "\U0001246f", "\U00033000", "\x1c\x85\xa0 x"):
        text = f"x{odd}x1{odd}1 {odd} {odd}'s\r\n "
        assert ids(encoder().encode(text)) == plain().encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"\xe0", b"\xa0", b"\x80", b"\xf4", b"\x8f", b"\x90", b"\xed", b"\x9f", b"\xc3", b"\xa9", b"a", b"\xff", b"\xc0", b"\xf0", b"\xbf"]), max_size=12))
def test_decoding_bytes_that_are_no_text(parts):
    table = B.ranks(PATH)
    assert "".join(B.Decoder(table).stream(table[p] for p in parts)) == b"".join(parts).decode(errors="replace")


def test_tables(spark):
    texts = [None, "", " ", "Hello, world's 12.5kg\n\n x", "é ́x ΑΣ 日本 語\r\n", "<|endoftext|>", "w" * 200000, "a b\t" * 20000, "\U00016ea7" * 5]
    rows = [(i % 7 if i else None, t, 3, "x") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, begun string")
    got = sorted((tuple(r) for r in B.round_trip_digest(docs, PATH, PATTERN).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    slow = [(i, len(e := plain().encode_ordinary(t or "") if len(t or "") < 10**5 else ids(B.Transducer(B.ranks(PATH))(t.encode()))), sha(",".join(map(str, e))), sha(t or "")) for i, t, _, _ in rows]
    assert got == sorted(slow, key=str)
    assert B.round_trip_digest(docs.limit(0), PATH, PATTERN).collect() == []
    apart = B.decoded(B.encoded(docs, PATH, PATTERN), PATH)
    assert sorted(map(str, apart.collect())) == sorted(map(str, B.round_trip(docs, PATH, PATTERN).collect()))
    back = B.decoded(spark.createDataFrame([(1, None), (2, []), (3, [10**9, 64]), (4, [None])], "doc_id long, ids array<int>"), PATH)
    assert sorted(tuple(r)[::2] for r in back.collect()) == [(1, None), (2, ""), (3, "\N{REPLACEMENT CHARACTER}a"), (4, "\N{REPLACEMENT CHARACTER}")]
