import random

import pytest

from noticeflow.llm import decontaminate

ITEMS = [
    (1, "A train leaves Paris at 9 with 120 passengers and reaches Lyon after 3 hours. How many passengers per hour is that?"),
    (2, "The farmer has 5 kg of apples and sells 2 kg of apples to Maria, so how many kg of apples are left for the farmer?"),
    (3, "What is the colour of the sky at noon?"),
    (4, None), (5, ""), (6, "12 13 14 15"),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(spark, benchmark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.changed for r in decontaminate.leaks(df, benchmark).collect()}


def test_verbatim_reparameterised_and_clean(spark, benchmark):
    a, b = ITEMS[0][1], ITEMS[1][1]
    rows = [
        (1, f"Some words before. {a} And after."),
        (2, a.replace("Paris", "Berlin").replace("Lyon", "Hamburg").replace("120", "77").replace("9", "11")),
        (3, b.replace("5 kg", "8 pounds").replace("2 kg", "3 pounds").replace("kg", "pounds").replace("Maria", "Chen")),
        (4, "An ordinary text about trains, farmers and apples that asks nothing of the kind at all, with 3 hours to go."),
        (5, "what is the COLOUR of the sky, at noon?"),
    ]
    got = found(spark, benchmark, rows)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3)}
    assert not got[1, 1] and got[2, 1] and got[3, 2]


def test_inconsistent_slots_are_no_leak(spark, benchmark):
    text = "The farmer has 5 kg of apples and sells 2 lb of apples to Maria, so how many oz of apples are left for the farmer?"
    mixed = text.replace("apples and", "apples, 7 kg and 9 kg, and")
    assert (1, 2) not in found(spark, benchmark, [(1, mixed)])
    one = "has 7 kg of plums"
    assert found(spark, benchmark, [(1, one)]) == {}


def test_against_word_by_word_search(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for k in range(30)]
    rows, want = [], set()
    for i in range(200):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            k, item = rng.choice(items)
            at = rng.randint(0, len(text))
            text[at:at] = item.split()
            want.add((i, k))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert set(found(spark, bench, rows)) == want


def test_blocks_of_the_benchmark_find_the_same(spark, benchmark, monkeypatch):
    rows = [(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, ITEMS[2][1])]
    want = found(spark, benchmark, rows)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert found(spark, benchmark, rows) == want
    df = spark.createDataFrame([*rows, (4, "clean")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()] == [4]


def test_edges(spark, benchmark):
    a = ITEMS[0][1]
    long = "filler words here " * 20_000 + a
    rows = [(None, a), (1, None), (2, ""), (3, long), (3, long), (4, "12 13 14 15")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    out = decontaminate.leaks(df, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in out) == [(0, 1), (3, 1), (3, 1)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()) == [1, 2, 4]
    assert decontaminate.leaks(df.limit(0), benchmark).collect() == []
    assert decontaminate.leaks(df, benchmark.limit(0)).collect() == []


def test_small_cache_gives_the_same_leaks(monkeypatch):
    index = decontaminate.Index([(i, t) for i, t in ITEMS if t])
    text = "Before. " + ITEMS[0][1] + " After."
    want = index.leaks(text, decontaminate.Words())
    monkeypatch.setattr(decontaminate, "CACHE_WORDS", 2)
    words = decontaminate.Words()
    assert [index.leaks(text, words) for _ in range(3)] == [want] * 3


def test_longest_stretch_when_two_slots_shared_a_value():
    item = ("then we put 2 red pens into the box and then 2 blue pens into that bag before anybody came home from "
            "school")
    index = decontaminate.Index([(1, item)])
    text = item.replace("2 red", "5 red").replace("2 blue", "3 blue")
    assert [i for i, word in enumerate(item.split()) if word == "2"] == [3, 11]
    (_, first, size, changed), = index.leaks(text + " it", decontaminate.Words())
    assert (first, size, changed) == (4, 19, True)
    assert index.leaks(" ".join(text.split()[:15]), decontaminate.Words()) == []


def test_copies_whatever_their_case_and_punctuation():
    index = decontaminate.Index([(i, t) for i, t in [*ITEMS, (7, "Tom has 12 red apples. How many are left?")] if t])

    def of(text):
        return [(index.ids[n], changed) for n, _, _, changed in index.leaks(text, decontaminate.Words())]

    short, long = ITEMS[2][1], ITEMS[0][1]
    for before in ("Quiz\n", "3) ", "- ", "so then ", "He asked, \""):
        assert of(before + short) == [(3, False)]
    for copy in (long.lower(), long.upper(), long.replace(".", "").replace("?", "")):
        assert of(copy) == [(1, False)]
    for text in ("Anna has 7 red apples. How many are left?", "Exercise\nAnna has 7 red apples, how many are left?",
                 "here Anna has 7 red apples How many are left"):
        assert of(text) == [(7, True)]
    assert of("Anna has 7 red apples. Few are left, how many?") == []


def test_values_of_several_words_are_one_slot():
    item = "Anyone who walks from Paris to the lake with five friends meets Maria there"
    index = decontaminate.Index([(1, item), (2, "Maria sold 3 kg of plums and then ate two of them")])
    words = decontaminate.Words()
    changes = {"Paris": "New York City", "five": "twenty five", "Maria": "Maria Lopez"}
    for old, new in changes.items():
        (_, first, size, changed), = index.leaks(item.replace(old, new), words)
        assert (first, size, changed) == (0, 14, True)
    text = item
    for old, new in changes.items():
        text = text.replace(old, new)
    back = decontaminate.Index([(1, text)])
    assert index.leaks(text, words) == [(0, 0, 14, True)] and back.leaks(item, words) == [(0, 0, 14, True)]
    for name in ("Anna", "Anna Maria Lopez"):
        (n, *_), = index.leaks(f"{name} sold twenty five pounds of plums and then ate six of them", words)
        assert n == 1
