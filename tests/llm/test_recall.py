"""Measured recall of the near-duplicate join on pairs just above its threshold."""

import random

from evenkeel.llm import chosen_path


def _similarity(a: str, b: str, k: int) -> float:
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def _pairs(count: int, k: int, low: float, high: float) -> list[tuple[str, str]]:
    """Texts of 80 to 200 words and copies with some words replaced, of similarity ``low`` to ``high``."""
    rnd, found = random.Random(11), []
    while len(found) < count:
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(80, 200))]
        copy = list(words)
        for at in rnd.sample(range(len(words)), rnd.randrange(1, 6)):
            copy[at] = f"x{rnd.randrange(10**6)}"
        a, b = " ".join(words), " ".join(copy)
        if low <= _similarity(a, b, k) < high:
            found.append((a, b))
    return found


def test_pairs_just_above_the_threshold_are_linked(spark):
    """3,000 pairs of similarity 0.85 to 0.90: every one is linked, and with its partner only."""
    pairs = _pairs(3000, 3, 0.85, 0.90)
    rows = [(2 * i + j, text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(docs).collect()}
    linked = sum(found[2 * i + 1] == 2 * i for i in range(len(pairs)))
    assert linked == len(pairs)
    assert all(found[2 * i] == 2 * i for i in range(len(pairs)))


def test_pairs_just_below_the_threshold_stay_apart(spark):
    pairs = _pairs(300, 3, 0.80, 0.85)
    rows = [(2 * i + j, text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["kept"] for r in chosen_path.near_duplicates(docs).collect())


def test_a_very_long_text_and_its_near_copy_are_linked(spark):
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(200_000)]
    copy = [*words[:190_000], *[f"y{i}" for i in range(5_000)]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, None), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in chosen_path.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
