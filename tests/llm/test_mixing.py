import heapq
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import mixing
from leafmill.llm.queries import TOKENIZER


def one_by_one(weights, seats, caps):
    got = [0] * len(weights)
    heap = [(-Fraction(w), i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(weights[i]) / (2 * got[i] + 1), i))
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 60)), min_size=1, max_size=7), st.integers(0, 150))
def test_sainte_lague_is_the_one_by_one_award(rows, seats):
    weights, caps = [r[0] for r in rows], [r[1] for r in rows]
    assert mixing.sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)


def test_many_seats_take_no_time():
    assert sum(mixing.sainte_lague([0.26, 0.5, 0.24], 10**12)) == 10**12


def tables(spark):
    docs = [(i, "w " * 100, " News " if i % 2 else "news", "x") for i in range(300)] + [(1000 + i, "w " * 50, "WEB", "x") for i in range(10)]
    docs += [(2000, "w w", None, "x"), (2001, "w w", "  ", "x"), (2002, None, "web", "x"), (2003, "w w w", "other", "x")]
    targets = [("news", 0.5, 1), ("web", 0.49, 3), ("absent", 0.01, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, size string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_plan_and_mixture(spark):
    docs, targets = tables(spark)
    plan = {r["source"]: r for r in mixing.mixture_plan(docs, targets, block=10).collect()}
    assert {s for s, r in plan.items() if not r["reachable"]} == {"web", "absent"}
    assert plan["news"]["size"] == 30_000 and plan["web"]["capacity"] == 1500 and plan["absent"]["size"] == 0
    chosen, report = mixing.mix(docs, targets, tokenizer=None, block=10, shard_size=3_000)
    rows = chosen.collect()
    uses = {}
    for r in rows:
        uses.setdefault((r["source"], r["id"]), []).append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in uses.values())
    assert max(len(c) for (s, _), c in uses.items() if s == "web") == 3 and max(len(c) for (s, _), c in uses.items() if s == "news") == 1
    got = {r["source"]: r for r in report.collect()}
    assert got["web"]["used"] == 1500 and abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    assert abs(got["news"]["used"] - got["news"]["quota"]) <= 50 * 16
    again = {(r["id"], r["copy"]) for r in mixing.mix(docs, targets, tokenizer=None, block=10, shard_size=3_000)[0].collect()}
    assert again == {(r["id"], r["copy"]) for r in rows}


def test_public_tokenizer_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "a"), (3, "", "a")], "doc_id long, text string, source string")
    got = {r["id"]: r["size"] for r in mixing.sized(df, "doc_id", "source", "text", TOKENIZER).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


def test_empty(spark):
    docs, targets = tables(spark)
    assert mixing.mixture_plan(docs.limit(0), targets).where("blocks > 0").count() == 0
    assert mixing.mixture_plan(docs, targets.limit(0)).count() == 0
    chosen, report = mixing.mix(docs.limit(0), targets, tokenizer=None)
    assert chosen.count() == 0 and report.count() == 3


def test_capped_sources_are_used_to_their_capacity(spark):
    docs = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w w w", "small") for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 4)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.mix(df, targets)[1].collect()}
    assert got["small"]["used"] == got["small"]["capacity"] == 84 and not got["small"]["reachable"]
    assert abs(got["big"]["used"] - got["big"]["quota"]) <= 10


def test_quotas_of_many_shards_add_up(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "CASE WHEN id % 5 < 4 THEN 'a' ELSE 'b' END AS source")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets, shard_size=300)
    got = {r["source"]: r for r in report.collect()}
    assert got["b"]["used"] == got["b"]["capacity"] and got["b"]["quota"] == got["b"]["capacity"]
    assert abs(got["a"]["used"] - got["a"]["quota"]) < 0.02 * got["a"]["quota"]
    assert chosen.groupBy("source", "id").count().where("source = 'a' AND count > 1").count() == 0
