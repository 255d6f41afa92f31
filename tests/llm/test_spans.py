import random

import numpy as np

from leafmill.llm import spans


def brute_pairs(rows, n):
    grams = {}
    for k, t in set(rows):
        for g in {t[i : i + n] for i in range(len(t or "") - n + 1)}:
            grams.setdefault(g, set()).add(k)
    return {(a, b) for ks in grams.values() for a in ks for b in ks if a < b}


def corpus(seed=4):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [make(rng.randint(38, 70)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [make(rng.randint(0, 60)), rng.choice(shared)[rng.randint(0, 8) :], make(rng.randint(0, 60))]
        rows.append((i, "".join(parts)))
    return [*rows, (100, rows[3][1]), (100, rows[3][1]), (101, None), (102, ""), (103, "short"), (None, rows[3][1])]


def test_suffix_array_and_search():
    rng = random.Random(1)
    for n in (1, 2, 30, 700):
        text = "".join(rng.choice("ab") for _ in range(n))
        codes = np.array([ord(c) - 96 for c in text])
        assert spans.suffix_array(codes).tolist() == sorted(range(n), key=lambda i: text[i:])
        index = spans.FMIndex.load(spans.FMIndex(codes + 1).dump())
        for k in (1, 3, 6):
            pattern = "".join(rng.choice("ab") for _ in range(k))
            row, lo, hi = index.search(np.array([[ord(c) - 95 for c in pattern]]))
            got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(row) else []
            assert got == [i for i in range(n - k + 1) if text[i : i + k] == pattern]


def test_pairs_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "evidence_id long, evidence_text string, md5 int, text string")
    want = brute_pairs([r for r in rows if r[0] is not None], 40)
    for shard in (100, 400_000):
        got = {tuple(r) for r in spans.shared_pairs(df, "evidence_id", "evidence_text", 40, shard_chars=shard).collect()}
        assert got == want
    assert want


def test_share_is_that_of_brute_force(spark):
    rows = [r for r in corpus(7) if r[0] is not None]
    df = spark.createDataFrame(rows, "evidence_id long, evidence_text string")
    by = dict(rows)
    for how in ({}, {"shard_chars": 300}, {"hot": 3}):
        got = {r["id"]: r for r in spans.shared_share(df, "evidence_id", "evidence_text", 40, **how).collect()}
        for k, t in by.items():
            t = t or ""
            others = [x for j, x in by.items() if j != k and x]
            covered = set()
            for i in range(len(t) - 39):
                if any(t[i : i + 40] in x for x in others):
                    covered |= set(range(i, i + 40))
            assert got[k]["shared_chars"] == len(covered), k
            assert got[k]["shared"] == (len(covered) / len(t) if t else 0.0)
            assert {i for a, b in got[k]["spans"] for i in range(a, b)} == covered


def test_classes_of_copies(spark):
    df = spark.createDataFrame([(3, "abcdef"), (1, "abcdef"), (1, "abcdef"), (2, "other text"), (4, "abc"), (5, None), (None, "abcdef")], "evidence_id long, evidence_text string")
    got = {(r["id"], r["class_id"], r["copies"]) for r in spans.text_classes(df, "evidence_id", "evidence_text", 5).collect()}
    assert got == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "evidence_id long, evidence_text string")
    assert spans.shared_pairs(df, "evidence_id", "evidence_text").count() == 0
    assert spans.shared_share(df, "evidence_id", "evidence_text").count() == 0


def test_winnow_guarantee():
    rng = random.Random(9)
    for _ in range(30):
        common = "".join(rng.choice("abc") for _ in range(60))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) + common + "".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) for _ in range(2))
        assert len(np.intersect1d(spans.winnow(a, 60)[0], spans.winnow(b, 60)[0]))


def test_matching_statistics_are_those_of_brute_force():
    rng = random.Random(5)
    for most in (4, 9, 60):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(6)] + ["abcabcabcabcabc", "cabcabcabcabx"]
        alphabet = sorted(set("".join(texts)))
        code = lambda t: [alphabet.index(c) + 2 if c in alphabet else 0 for c in t]
        parts, owner = [], []
        for i, t in enumerate(texts):
            parts += [1, *code(t)]
            owner += [i] * (len(t) + 1)
        index = spans.FMIndex.load(spans.FMIndex(np.array(parts), most, np.array(owner)).dump())
        asked = [*texts, "zzabcabzz", "x", ""]
        two = np.array([True] * len(texts) + [False] * 3)
        whole, ends = np.array([c for t in asked for c in code(t)]), np.cumsum([len(t) for t in asked])
        got = {}
        for piece, place, lo, hi, depth in index.statistics(whole, ends, two):
            for p, i, a, b, d in zip(piece.tolist(), place.tolist(), lo.tolist(), hi.tolist(), depth.tolist()):
                got[p, i - (int(ends[p]) - len(asked[p]))] = min(d, most)
        for p, t in enumerate(asked):
            others = [x for i, x in enumerate(texts) if i != p]
            for i in range(len(t)):
                n = max((n for n in range(len(t) - i + 1) if any(t[i : i + n] in x for x in others)), default=0)
                assert got.get((p, i), 0) == min(n, most), (p, i)


def test_one_sentence_of_many_texts_gives_linear_rows(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = make(60)
    for n in (50, 100):
        df = spark.createDataFrame([(i, make(40) + common + make(40)) for i in range(n)], "evidence_id long, evidence_text string")
        for how in ({}, {"hot": 10, "shard_chars": 1000}):
            assert spans.shared_intervals(df, "evidence_text", 50, **how).select("md5").distinct().count() == n
            got = spans.shared_share(df, "evidence_id", "evidence_text", 50, **how).collect()
            assert len(got) == n and all(len(r["spans"]) == 1 and r["shared_chars"] >= 60 for r in got)
