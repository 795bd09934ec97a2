import random

from tracemill.llm import decontaminate as D

ITEM = "If Alice buys 12 apples and Bob buys 7 apples at 3 $ each, how many dollars does Alice pay more than Bob in total today?"


SHORT = "the old red house worth ? "


def test_canonical():
    assert D.canonical("12.5kg,", False, False) == [("\x00number", "12.5"), ("\x00unit", "kg")]
    assert D.canonical("Bob", False, False) == [("\x00name", "bob")] and D.canonical("Bob", True, False) == [("bob", "")]
    assert D.canonical("in", False, False) == [("in", "")] and D.canonical("in", False, True) == [("\x00unit", "in")]
    assert D.canonical("THE!!", False, False) == [("the", "")]
    assert D.canonical("***", True, False) == []


def test_windows_match_plain_loop():
    t = D.Templates()
    for text in ("", "one", ITEM, "A b.\nC d 5 kg\n\n7 km e f g", "## x 3 4 5", "5 in. In 5. In x", "a.b.c 12.5kg x-y Bob. Bob Bob!", "THE Car, Bus; a A. A ÉCOLE École, x., M 5 M m 5 m. M"):
        words, context, h = t.read([text])[0]
        plain, starts, after = [], True, False
        for line in text.split("\n"):
            starts, after = True, False
            for w in line.split():
                found = D.canonical(w, starts, after and not starts)
                plain += found
                starts = bool(D._END.search(w))
                after = bool(found) and found[-1][0] == "\x00number"
        assert h.tolist() == [D.xxhash.xxh64_intdigest(x) for x, _ in plain], text
        n = max(1, len(plain) - 4) if plain else 0
        assert len(t.windows(h)) == n
        assert t.slots(words, context, list(range(n))) == [[v for _, v in plain[i : i + 5]] for i in range(n)]


def test_planted_items(spark):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    other = ITEM.replace("Alice", "Carla").replace("Bob", "Dan").replace("12", "40").replace("7", "8").replace("3 $", "5 €")
    broken = ITEM.replace("Bob", "Dan", 1).replace("Alice", "Eva", 1)
    rows = [
        (1, filler(50) + ". " + ITEM + " " + filler(50)),
        (2, filler(20) + ".\n" + other + "\n" + filler(3000)),
        (3, filler(200)),
        (4, " ".join(ITEM.split()[:12]) + " " + filler(30)),
        (5, "one two"),
        (6, "one two three"),
        (7, None),
        (8, ""),
        (None, ITEM),
        (9, ITEM),
        (9, ITEM),
        (9, filler(40)),
        (10, " ".join(broken.split())),
        (11, "we saw What is " + SHORT + filler(9)),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, row int, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "One two."), (3, None), (4, " ... "), (5, filler(30)), (6, "What is " + SHORT)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (None, 1), (9, 1), (11, 6)}
    assert got[1, 1].kind == "exact" and got[1, 1].containment == 1 and got[2, 1].kind == "reparameterised"
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7, 8, 9, 10]
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.contaminated(docs.limit(0), bench).collect() == []
