import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import evaluation, matching, navigator, retrieval

STOP_FREE = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    toks = {i: (t or "").split() for i, t in docs}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for w in toks.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    m = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * m for t, x in raw.items()}
    out = set()
    for q, text in queries:
        s = {i: round(sum(idf.get(t, 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in (text or "").split() if t in w), 9) for i, w in toks.items()}
        for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k], 1):
            out.add((q, r, i))
    return out


@pytest.mark.parametrize("how", [{}, {"sent_terms": 0, "split": 3}, {"sent_terms": 0, "query_block": 1}])
def test_bm25_is_brute_force(spark, how):
    rng = random.Random(2)
    wide = how.get("split")
    docs = [(f"d{i:02d}", " ".join(rng.choice(STOP_FREE) for _ in range(rng.randint(1, 8)))) for i in range(25)] + [("d90", None), ("d91", ""), ("d92", "alpha alpha"), ("d93", "alpha alpha")]
    if wide:  # rare terms make the mean idf positive
        docs += [(f"r{i}", f"rare{i} other{i}") for i in range(30)]
    queries = [("q1", "alpha alpha beta"), ("q2", "nothing"), ("q3", None), ("q4", "zeta")]
    got = retrieval.bm25(spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(queries, "query_id string, query string"), 3, **how)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == brute_bm25(docs, queries, 3)


def test_bm25_of_nothing(spark):
    d, q = spark.createDataFrame([], "id string, text string"), spark.createDataFrame([("q", "x")], "query_id string, query string")
    assert retrieval.bm25(d, q).count() == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_dense_is_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 8))
    v[5] = v[6]
    rows = [(i, [float(x) for x in v[i]]) for i in range(40)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = retrieval.dense_top_k(df, df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 4, query_block=block)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    want = {(q, r, i) for q in range(0, 40, 10) for r, i in enumerate(sorted(range(40), key=lambda i: (-s[q, i], i))[:4], 1)}
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want


def plain_beam(nodes, q, k, m):
    below = {}
    for n in nodes:
        below.setdefault((n[0], n[2]), []).append(n)
    dot = lambda n: round(sum(a * b for a, b in zip(n[5], q)), 9)
    root = sorted((n for n in nodes if n[2] is None), key=lambda n: (-dot(n), n[0]))[0]
    frontier, found, level = [root], [], 0
    while frontier:
        pool = [(c, p) for p, f in enumerate(frontier) for c in sorted(below.get((f[0], f[1]), []), key=lambda c: c[3])]
        kept = [c for c, _ in sorted(pool, key=lambda x: (-dot(x[0]), x[1], x[0][3]))[:m]]
        found += [(c, level, i) for i, c in enumerate(kept) if (c[0], c[1]) not in below]
        frontier = [c for c in kept if (c[0], c[1]) in below]
        level += 1
    best = {}
    for c, lv, i in found:
        if c[4] not in best or dot(c) > best[c[4]][0]:
            best[c[4]] = (dot(c), lv, i, c[1])
    return [x[3] for x in sorted(best.values(), key=lambda x: (-x[0], x[1], x[2]))[:k]]


def test_beam_is_the_plain_one(spark):
    rng = random.Random(8)
    vec = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    nodes = []
    for d in range(3):
        nodes.append((f"d{d}", "r", None, -1, None, vec()))
        ids = ["r"]
        for i in range(25):
            up = rng.choice(ids)
            nodes.append((f"d{d}", f"n{i}", up, i, f"d{d}_c{i % 20}", vec()))
            if rng.random() < 0.5:
                ids.append(f"n{i}")
    queries = [(f"q{i}", vec()) for i in range(6)]
    df = spark.createDataFrame(nodes, "doc_id string, node_id string, parent_id string, ord int, chunk_id string, vector array<double>")
    qs = spark.createDataFrame(queries, "query_id string, vector array<double>")
    got = {}
    for r in retrieval.beam(df, qs, 5, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == {q: plain_beam(nodes, v, 5, 3) for q, v in queries if plain_beam(nodes, v, 5, 3)}
    chunk_vectors = spark.createDataFrame([("d0_c1", [1.0, 0.0, 0.0, 0.0])], "chunk_id string, vector array<double>")
    assert {r["scored_by"] for r in retrieval.rerank(retrieval.beam(df, qs, 5, 3), qs, chunk_vectors).collect()} <= {"chunk", "node"}


def test_metrics(spark):
    rows = spark.createDataFrame([("q1", "a", ["a", "b"]), ("q2", "z", ["x", "y", "z"]), ("q3", "m", ["a"]), ("q4", None, None), ("q5", "f", ["1", "2", "3", "4", "5", "f"])], "query_id string, gold string, ids array<string>")
    got = {r["query_id"]: (r["correct_at_1"], r["hit_at_k"], r["gold_rank"], round(r["reciprocal_rank"], 4)) for r in evaluation.retrieval_metrics(rows).collect()}
    assert got == {"q1": (1, 1, 1, 1.0), "q2": (0, 1, 3, 0.3333), "q3": (0, 0, None, 0.0), "q4": (0, 0, None, 0.0), "q5": (0, 0, None, 0.0)}


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None)], "k string, x double")
    got = {r["k"]: (r["n"], r["mean"], r["std"]) for r in evaluation.latency_statistics(df, ["k"], "x").collect()}
    assert got["b"] == (1, 5.0, 0.0) and got["c"] == (0, None, None) and round(got["a"][2], 4) == 1.4142


def test_selection(spark):
    df = spark.createDataFrame([("q", True, 1), ("q", False, 2), ("p", False, 1), ("p", False, 2), (None, True, 3)], "query_id string, ok boolean, ord int")
    assert {(r["query_id"], r["ord"]) for r in evaluation.keep_best(df, ["query_id"], F.col("ok"), F.col("ord")).collect()} == {("q", 1), ("p", 2), (None, 3)}
    c = spark.createDataFrame([("a", "q1"), ("a", "q2"), ("b", "q1")], "config string, query_id string")
    assert {r["query_id"] for r in evaluation.common_queries(c, "config").collect()} == {"q1"}
    left = spark.createDataFrame([("m", None, 1), ("m", 5, 2)], "method string, top_m int, v int")
    right = spark.createDataFrame([("m", None, 0.5)], "method string, top_m int, coverage double")
    assert {(r["v"], r["coverage"]) for r in evaluation.join_on_nullable(left, right, ["method", "top_m"]).collect()} == {(1, 0.5), (2, None)}
    ids = spark.createDataFrame([("A_B_0001",), ("A_1",), ("Z",), (None,)], "id string")
    docs = spark.createDataFrame([("A",), ("A_B",)], "doc string")
    assert {r["id"]: r["document"] for r in evaluation.document_of(ids, docs, "id", "doc").collect()} == {"A_B_0001": "A_B", "A_1": "A", "Z": None, None: None}
    plan = evaluation.assign_plan(ids.where("id IS NOT NULL"), "id", 7).collect()
    assert sorted(r["planned"] for r in plan) == [2, 2, 3]


def test_matching(spark):
    e = spark.createDataFrame([(1, "d", "Net sales were 55,893 million"), (2, "d", ""), (3, "d", "Line one here\nLine two there 12"), (4, "x", "no chunks")], "evidence_id long, doc string, text string")
    c = spark.createDataFrame([("c1", "d", "In 2020 net sales were $55,893 million."), ("c2", "d", "line one here and 12"), ("c3", "d", None)], "chunk_id string, doc string, text string")
    s = matching.match_scores(e, c)
    best = {r["evidence_id"]: r for r in matching.best_matches(s).collect()}
    assert best[1]["chunk_id"] == "c1" and best[1]["score"] == 1.0 and 2 not in best and best[3]["chunk_id"] == "c2" and 4 not in best
    q = spark.createDataFrame([(1, "qa"), (2, "qb"), (3, "qc"), (4, "qc")], "evidence_id long, question string")
    truth = {r["question"]: (r["chunk_id"], r["reason"]) for r in matching.ground_truth(q, matching.best_matches(s)).collect()}
    assert truth == {"qa": ("c1", "kept"), "qb": (None, "no_match"), "qc": (None, "evidence_count_not_one")}
    assert matching.longest_common("abcdef", "xxbcdyy") == 3 and matching.longest_common("", "a") == 0


def test_walk(spark):
    nodes = [("d", "a", None, 0, None, "revenue part"), ("d", "b", "a", 1, "k1", "revenue growth in europe"), ("d", "c", "a", 2, "k2", "revenue decline"), ("d", "e", None, 3, "k3", "other matter")]
    df = spark.createDataFrame(nodes, "doc_id string, node_id string, parent_id string, ord int, chunk_id string, text string")
    q = spark.createDataFrame([("q1", "d", "revenue growth"), ("q2", "none", "x"), ("q3", "d", None)], "query_id string, doc_id string, query string")
    got = {r["query_id"]: r for r in navigator.walk_trees(q, df).collect()}
    assert got["q1"]["top1"] == "k1" and got["q1"]["sufficient"] and got["q1"]["top5"][0] == "k1" and got["q2"]["top1"] is None and got["q2"]["top5"] == [] and got["q3"]["top1"] is None

    class Lost:
        def choose(self, query, node, children):
            return "no such node"

        def sufficient(self, query, chunk):
            return "false"

        def rank(self, query, chunks):
            return [c["chunk_id"] for c in chunks]

    rows = [dict(zip(("doc_id", "node_id", "parent_id", "ord", "chunk_id", "text"), n)) for n in nodes]
    out = navigator.Walk(rows, Lost()).retrieve("q")
    assert out == {"top1": "k1", "top5": ["k1", "k2", "k3"], "read": 3, "sufficient": False}
