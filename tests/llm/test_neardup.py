import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.functions.words import WordHash, window_hashes, words
from leafmill.llm import neardup


def brute(rows, shingle, threshold, least):
    sets = {}
    for k, t in rows:
        w = words(t)
        if k is not None and t is not None and len(w) >= max(least, shingle):
            sets[k] = set(zip(*(w[i:] for i in range(shingle))))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 90))]
        rows.append((f"c{i:03d}", " ".join(base)))
        for j in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rows.append((f"c{i:03d}_{j}", " ".join(edited)))
    return rows


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64)]), np.concatenate([both, rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (neardup.signature(a, 512) == neardup.signature(b, 512)).mean()
    assert abs(same - 0.6) < 0.12
    assert (neardup.signature(a, 64) == neardup.signature(a[::-1], 64)).all()


def test_unrelated_long_texts_do_not_agree():
    rng = np.random.default_rng(2)
    for n in (8_000, 65_000):
        sigs = [neardup.signature(rng.integers(0, 2**63, n).astype(np.uint64), 192) for _ in range(6)]
        agree = [(x == y).mean() for i, x in enumerate(sigs) for y in sigs[:i]]
        assert np.mean(agree) < 0.01
        assert not any(set(neardup.band_keys(x, 4).tolist()) & set(neardup.band_keys(y, 4).tolist()) for i, x in enumerate(sigs) for y in sigs[:i])


def groups_of(pairs, keys):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k: find(k) for k in keys}


def test_groups_are_the_components_of_brute_force(spark):
    rows = corpus(7, 40) + [(f"h{i:03d}", " ".join(f"x{j}" for j in range(40)) + f" y{i}") for i in range(60)] + [("copy", corpus(7, 40)[0][1])]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    want = groups_of(brute(rows, 4, 0.6, 30), {k for k, _ in rows})
    for limit in (512, 4):
        got = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(df, shingle=4, threshold=0.6, min_words=30, bucket_limit=limit).collect()}
        assert got == want


def test_groups_of_many_near_equal_texts_verify_few_pairs(spark, monkeypatch):
    rows = [(f"h{i:04d}", " ".join(f"x{j}" for j in range(40)) + f" y{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    counts, checked = [], neardup._checked
    monkeypatch.setattr(neardup, "_checked", lambda pairs, *a: counts.append(pairs.count()) or checked(pairs, *a))
    out = neardup.near_duplicate_groups(df, shingle=4, threshold=0.6, min_words=30)
    assert [r[:] for r in out.groupBy("group_id").count().collect()] == [("h0000", 600)]
    assert sum(counts) < 20 * 600


def test_pairs_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, shingle=4, threshold=0.6, min_words=30).collect()}
    assert got == brute(rows, 4, 0.6, 30)
    assert got


def test_overfull_buckets_lose_nothing(spark):
    rows = corpus(5, 12) + [(f"h{i}", " ".join(f"x{j}" for j in range(60)) + f" y{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, shingle=4, threshold=0.6, min_words=30, bucket_limit=8).collect()}
    assert got == brute(rows, 4, 0.6, 30)


def test_nulls_short_texts_copies_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [("a", long, "x"), ("a", long, "y"), ("b", long, None), ("c", long + " end", "z"), ("d", "too short", "q"), ("e", None, "q"), ("f", "", "q"), (None, long, "q")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, cid string").withColumns({"md5": F.lit("m"), "key": F.lit(1), "id": F.lit(2), "n": F.lit(0)})
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, shingle=4, threshold=0.6, min_words=30).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r["id"]: (r["group_id"], r["group_size"]) for r in neardup.near_duplicate_groups(df, shingle=4, threshold=0.6, min_words=30).collect()}
    assert groups == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1), "f": ("f", 1)}


def test_very_many_copies_come_as_a_star(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(f"k{i:02d}", text) for i in range(20)] + [("other", text + " more")], "chunk_id string, text string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, shingle=4, threshold=0.6, min_words=30, expand_copies=5).collect()}
    assert got == {("k00", f"k{i:02d}") for i in range(1, 20)} | {("k00", "other")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert neardup.near_duplicate_pairs(df).count() == 0
    assert neardup.near_duplicate_groups(df).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "a string, b string")
    got = {r["id"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(61)} | {"z1": "z1", "z2": "z1"}


def test_window_hashes_tell_orders_apart():
    h = WordHash()
    a, b = window_hashes(h.of("a b c d".split()), 4), window_hashes(h.of("b a c d".split()), 4)
    assert len(a) == 1 and a[0] != b[0] and not len(window_hashes(h.of(["a"]), 4))
