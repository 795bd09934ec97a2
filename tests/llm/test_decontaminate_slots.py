from tracemill.llm import decontaminate as D

FILLER = "we walked along the quiet river until the last light of the long evening faded behind the dark hills"
ITEM = (
    "In the first week the old farmer Jonas carried 12 baskets of ripe fruit to the market and came back with empty hands, "
    "while in the second week he sold all of them within one short morning because the people who lived near the harbour had heard "
    "how sweet they were and paid 12 coins to the family of Jonas before noon."
)
SUM = "There are 2 red balls in the wide box and 2 blue balls in the narrow box so how many balls are there"


def test_one_edit_of_a_repeated_value_and_equal_numbers_that_change_apart(spark):
    rows = [
        (1, ITEM.replace("12", "13", 1)),
        (2, ITEM.replace("Jonas", "Peter", 1)),
        (3, ITEM.replace("Jonas", "Peter")),
        (4, SUM.replace("2", "3", 1).replace("2", "4")),
        (5, FILLER),
        (6, " ".join(ITEM.split()[:20]) + " " + FILLER),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, SUM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2)}
    assert got[1, 1].kind == "reparameterised" and got[1, 1].matched == got[1, 1].item_windows
    # the five windows around the one other name contradict the rest, which is a literal copy
    assert got[2, 1].kind == "exact" and got[2, 1].matched == got[2, 1].item_windows - 5
    assert got[3, 1].matched == got[3, 1].item_windows and got[4, 2].containment == 1


def test_windows_that_count():
    jo = [(0, 3, ["jo", "", ""], ["al", "", ""]), (1, 3, ["", "", "jo"], ["", "", "jo"]), (4, 3, ["", "jo", ""], ["", "jo", ""])]
    assert D.counted(jo) == ([1, 4], True)
    assert D.counted(jo[:2]) == ([1], True)
    assert D.counted([(0, 3, ["jo", "2"], ["al", "3"]), (5, 3, ["2", "jo"], ["4", "al"])]) == ([0, 5], False)
    # the same binding at all offsets, and no two names to one
    assert D.counted([(0, 3, ["jo"], ["al"]), (1, 3, ["jo"], ["al"]), (5, 4, ["jo"], ["ed"])]) == ([0, 1], False)
    assert D.counted([(0, 3, ["jo"], ["al"]), (1, 3, ["jo"], ["al"]), (5, 3, ["bo"], ["al"])]) == ([0, 1], False)


def test_one_word_between_the_halves_does_not_hide_a_contradiction(spark):
    item = "If Alice buys twelve apples and Bob buys seven apples at the market then how many more coins does Alice pay there than what Bob has to pay in total today"
    words = item.replace("Alice", "Carla").replace("Bob", "Dan").split()
    other = item.replace("Alice", "Eva").replace("Bob", "Zed").split()
    both = item.replace("Alice", "Eva").replace("Bob", "Eva")
    half = len(words) // 2
    rows = [(1, " ".join(words)), (2, " ".join(words[:half] + other[half:])), (3, " ".join([*words[:half], "then", *other[half:]])), (4, both), (5, " ".join([*words[:half], "then", *words[half:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in D.contaminated(docs, bench, share=0.7).collect()} == {1, 5}


def test_a_window_that_repeats_in_a_long_text_and_in_many_items(spark):
    docs = spark.createDataFrame([(1, "a 1 b 2 c " * 300), (2, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"a {i} b {i} c a {i} b {i} c a {i} b") for i in range(30)], "item_id long, text string")
    got = D.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, i) for i in range(30)} and all(r.containment == 1 for r in got)


def test_other_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "p q r s t u v", 5, 6, "k"), (2, ITEM, 7, 8, "k")], "doc_id long, text string, row_of_text int, row_to_drop int, row string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in D.decontaminated(docs, bench).collect()] == [(1, "p q r s t u v", 5, 6, "k")]


def test_sieve_keeps_every_text_with_a_window_of_the_benchmark_and_few_others():
    import random

    import numpy as np
    import pyarrow as pa

    from tracemill.llm import decontaminate as D

    rng = random.Random(5)
    words = ["of", "a", "in", "été", "Éta", "km", "5", "12km", "Anna", "runs", "IT", "x.y", "***", "it's", "fast,", "home.", "ß", "²", "%", "|", "McCoy", "—", "7", "s"]
    bench = [" ".join(rng.choices(words, k=rng.randint(5, 20))) for _ in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array(bench)], ["text"])
    known = D._filter_of(np.unique(np.concatenate([b.column(0).to_numpy() for b in D._known(D.WINDOW)(iter([batch]))])).tolist(), 20)
    templates = D.Templates()
    windows = np.concatenate([templates.windows(h) for starts in (True, False) for _, _, h in templates.read([*bench, *words], starts)])
    docs = ["", " \n", *words]
    for _ in range(4000):
        parts = rng.choice(bench).split(" ")
        at = rng.randrange(len(parts))
        some = parts[at : at + rng.randint(1, 9)]
        for _ in range(rng.randint(0, 2)):
            some.insert(rng.randrange(len(some) + 1), rng.choice([*words, "\x85", " ", "zzz", "…"]))
        text = rng.choice([" ", " ", "\n", "\xa0", "\x1c"]).join(some)
        docs.append("".join(rng.choice([c] * 9 + [c.upper(), c + "."]) for c in text))
    kept = set()
    for start in range(0, len(docs), 50):
        kept |= {start + i for i in D.sieve(pa.array(docs)[start : start + 50], known).tolist()}
    need = {i for i, (_, _, h) in enumerate(templates.read(docs)) if len(h) >= D.WINDOW and np.isin(templates.windows(h), windows).any()}
    assert len(need) > 300 and need <= kept
    short = {i for i, (_, _, h) in enumerate(templates.read(docs)) if 0 < len(h) < D.WINDOW and np.isin(templates.windows(h), windows).any()}
    known = D._filter_of(np.concatenate([b.column(0).to_numpy() for b in D._known(D.WINDOW)(iter([pa.RecordBatch.from_arrays([pa.array([*bench, *words])], ["text"])]))]).tolist(), 20)
    found = {start + i for start in range(0, len(docs), 50) for i in D.sieve(pa.array(docs[start : start + 50]), known).tolist()}
    assert short and short <= found
    # word salad of known words, in small letters, is left out
    salad = [" ".join(rng.choices(["of", "a", "in", "été", "km", "runs", "zzz"], k=60)) for _ in range(200)]
    assert len(D.sieve(pa.array(salad), known)) < 100
