import numpy as np

from leafmill.functions.words import WordHash, words
from leafmill.llm import leaks

A = " ".join(f"a{i}" for i in range(14))
B = " ".join(f"b{i}" for i in range(14))


def rows(spark):
    docs = [(1, f"x y z {A} q r", 5), (2, f"{B} in between {A}", 5), (3, f"{' '.join(A.split()[:11])} no", 5), (4, None, 5), (5, "", 5), (1, f"x y z {A} q r", 6), (6, A.upper().replace(" ", ", "), 7)]
    items = [(10, f"{A} {B}", "t"), (11, "  " + A.title() + "\n", "t"), (12, None, "t"), (13, "short", "t"), (10, f"{A} {B}", "t")]
    return spark.createDataFrame(docs, "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string, doc string")


def test_reordered_passages_and_both_paths(spark):
    docs, items = rows(spark)
    want = {(1, 10), (1, 11), (2, 10), (2, 11), (6, 10), (6, 11)}
    for how in ({}, {"broadcast_seeds": 0}, {"broadcast_seeds": 0, "split": 1}):
        got = {(r["doc"], r["item"]): r for r in leaks.find_leaks(docs, items, **how).collect()}
        assert set(got) == want
        assert got[2, 10]["tiles"] == 2 and got[2, 10]["covered"] == 28 and got[2, 10]["coverage"] == 1.0
        assert got[1, 10]["longest"] == 14 and got[1, 10]["coverage"] == 0.5


def test_tiles_are_longest_first_and_never_overlap():
    h = WordHash()
    text, item = h.of(words("a b c d e f x a b c")), h.of(words("a b c y b c d e f"))
    got = leaks.tiles(text, item, 2)
    assert got[0] == (1, 4, 5)
    marked = [p for i, _, n in got for p in range(i, i + n)]
    assert len(marked) == len(set(marked))
    assert leaks.tiles(np.array([], np.uint64), item, 2) == []


def test_empty(spark):
    docs, items = rows(spark)
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
