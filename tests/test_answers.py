import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import providers
from leafmill.functions.words import token_count, words
from leafmill.operators import answers, assistant, evaluation, sections, toc, trees
from leafmill.plans import report_queries
from leafmill.sources.workspace import Workspace

CHUNK = "chunk_id string, retrieval_chunk_id string, canonical_chunk_id string, doc_name string, bank_name string, title string, heading string, text string, generate_queries boolean, num_queries int"


def test_requests_and_replies(spark):
    rows = [("a", None, "c", "D", None, None, "h", "text", True, 2), ("b", "", "", None, None, "t", None, None, True, 1), ("n", None, None, "D", "B", "t", "h", "x", None, 3), ("z", None, None, "D", "B", "t", "h", "x", True, None)]
    req = answers.question_requests(spark.createDataFrame(rows, CHUNK))
    got = {r["custom_id"]: r for r in req.collect()}
    assert set(got) == {"row-a", "row-b"} and got["row-a"]["chunk_id"] == "c" and got["row-b"]["chunk_id"] == "b" and got["row-b"]["doc_name"] == "unknown"
    assert got["row-a"]["prompt"].endswith("Questions wanted: 2\n\ntext")
    reply = json.dumps({"questions": [{"question": "q1", "answer": "a1"}, {"question": None}]})
    replies = spark.createDataFrame([("row-a", reply, 1, None, 3), ("row-b", "{cut", 1, 1, 2), ("row-x", reply, 1, 1, 2), ("row-b", None, 1, 1, 2)], "custom_id string, content string, input_tokens int, output_tokens int, total_tokens int")
    out = {r["query_id"]: (r["query"], r["answer"], r["query_generation_output_tokens"]) for r in answers.questions_of(replies, req).collect()}
    assert out == {"c_q1": ("q1", "a1", 0), "c_q2": ("", "", 0)}


def test_answers_are_resumed(spark):
    df = spark.createDataFrame([("q1", "m", "what?", ["one", "two"], ["x"]), ("q2", "m", "why?", None, None), ("q3", "m", None, ["three"], [])], "query_id string, config string, query string, top5_chunks array<string>, top1_chunks array<string>")
    req = answers.answer_requests(df, 5)
    assert {r["answer_id"] for r in req.collect()} == {"m__q1__top5", "m__q2__top5", "m__q3__top5"}
    assert answers.answer_requests(df, 1).where("query_id = 'q3'").first()["context"] == ""
    with pytest.raises(ValueError):
        answers.answer_requests(df, 3)
    done = spark.createDataFrame([("m__q1__top5", ""), ("m__q3__top5", "boom")], "answer_id string, error string")
    got = {r["answer_id"]: r["generated_answer"] for r in answers.generated_answers(req, done=done).collect()}
    assert set(got) == {"m__q2__top5", "m__q3__top5"} and got["m__q2__top5"] == answers.NO_ANSWER and "three" in got["m__q3__top5"]
    rows = [("1", "q", "55 million", "It was 55 million."), ("2", "q", "x", " insufficient INFORMATION to answer the question. "), ("3", "q", "yes", "no"), ("4", "", "x", "x"), ("5", "q", None, "x"), ("6", "q", "a", "a")]
    j = spark.createDataFrame(rows, "answer_id string, query string, expected string, generated_answer string")
    assert {r["answer_id"]: r["category"] for r in answers.judged(j, done=spark.createDataFrame([("6", None)], "answer_id string, error string")).collect()} == {"1": "correct", "2": "no_answer", "3": "incorrect"}

    class Says:
        def complete(self, prompt):
            return "partly"

    assert {r["answer_id"]: r["category"] for r in answers.judged(j, Says()).collect()} == {"1": "partly", "2": "no_answer", "3": "partly", "6": "partly"}
    assert answers.judged(j.limit(0)).count() == 0 and answers.generated_answers(req.limit(0)).count() == 0


def test_documents_and_preferences(spark):
    q = spark.createDataFrame([("q1", "Credit risk of Acme"), ("q2", None), ("q3", "nothing")], "query_id string, query string")
    d = spark.createDataFrame([("d1", "Acme annual report"), ("d2", "acme credit risk"), ("d3", None)], "doc_id string, description string")
    for split in (10_000, 1):
        assert [(r["query_id"], r["rank"], r["doc_id"], r["shared"]) for r in assistant.documents_by_description(q, d, split=split).orderBy("rank").collect()] == [("q1", 1, "d2", 3), ("q1", 2, "d1", 1)]
    p = spark.createDataFrame([("CREDIT", "Look at note 5."), ("risk", "Mind the cover."), ("x", None), (None, "y")], "topic string, advice string")
    got = {r["query_id"]: r["query"] for r in assistant.with_preferences(q, p).collect()}
    assert got == {"q1": "Credit risk of Acme\nLook at note 5.\nMind the cover.", "q2": "", "q3": "nothing"} or got["q2"] in ("", None)


def _plain_documents(q, d, k):
    asked, held = {}, {}
    for rows, to in ((q, asked), (d, held)):
        for i, t in rows:
            to.setdefault(i, []).extend(set(words(t)))
    out = []
    for i, own in asked.items():
        best = sorted((-sum(own.count(w) * h.count(w) for w in set(own)), doc is None, doc or "", doc) for doc, h in held.items())
        out += [(i, r, doc, -n) for r, (n, _, _, doc) in enumerate(best[:k], 1) if n < 0]
    return sorted(out, key=str)


def test_documents_as_counted_plainly(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choices(["the", "of", "Ä", "risk", *"bcdefghijklmnop"], k=rnd.randrange(n)))
    q = [(f"q{i}", text(9)) for i in range(60)] + [("q1", "the risk of the risk"), (None, "the b"), ("none", None), ("long", " ".join(f"w{i}" for i in range(300)))]
    d = [(f"d{i}", text(30)) for i in range(50)] + [("d1", "the risk"), (None, "the b of c"), ("e", None), ("z", " ".join(f"w{i}" for i in range(5, 290)))]
    asked, held = spark.createDataFrame(q, "query_id string, query string"), spark.createDataFrame(d, "doc_id string, description string")
    for k, split, sent in ((5, 10_000, 2_000_000), (5, 3, 100), (1, 7, 2_000_000), (100, 2, 2_000_000)):
        out = assistant.documents_by_description(asked, held, k, split, sent)
        assert sorted((tuple(r) for r in out.collect()), key=str) == _plain_documents(q, d, k)
    assert assistant.documents_by_description(asked.limit(0), held).count() == 0 and assistant.documents_by_description(asked, held.limit(0)).count() == 0


def test_documents_of_common_words_make_no_pairs(spark):
    """Words that all questions and documents have don't move a row for each pair of them."""
    n = 500
    asked = spark.createDataFrame([(f"q{i}", f"What was the name of x{i}?") for i in range(n)], "query_id string, query string")
    held = spark.createDataFrame([(f"d{i:03}", f"What was the price of x{i}") for i in range(n)], "doc_id string, description string")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    moved = lambda: sum((x := it.next()).shuffleWriteRecords() for it in [store.stageList(None, False, False, none, None).iterator()] for _ in iter(it.hasNext, False))
    before = moved()
    got = assistant.documents_by_description(asked, held).collect()
    assert len(got) == 5 * n and {(r["query_id"][1:], r["doc_id"]) for r in got if r["rank"] == 1} == {(str(i), f"d{i:03}") for i in range(n)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert moved() - before < n * n / 5


def test_documents_with_nulls_as_in_sql(spark, tmp_path):
    """A tree of unknown time is the latest; of equals a document without a name comes last."""
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "d", "red", at), (2, "d", "blue", None), (3, None, "blue", at), (None, "e", "blue", at), (4, "e", "red", at)], "tree_id bigint, doc_name string, doc_description string, built_at timestamp").write.parquet(str(tmp_path / "trees.parquet"))
    spark.createDataFrame([("q", "blue?"), ("q", "blue?"), ("r", "red?")], "query_id string, query string").write.parquet(str(tmp_path / "queries.parquet"))
    got = [(r["query_id"], r["rank"], r["doc_id"], r["shared"]) for r in report_queries.rt_documents(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [("q", 1, "d", 1), ("q", 2, None, 1), ("r", 1, "e", 1)]


def test_tools_loop(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.index_pages(spark.createDataFrame([("d", 1, "1 First part\nSome words"), ("d", 2, "2 Second part\nOther words")], "doc_id string, page int, text string"))

    class Script:
        def __init__(self, *replies):
            self.replies, self.seen = list(replies), []

        def complete(self, prompt):
            self.seen.append(prompt)
            return self.replies.pop(0) if self.replies else "not json"

    s = Script('{"tool": "document"}', "oops", '{"tool": "fly"}', '{"tool": "pages", "pages": "2"}', '{"answer": "Other"}')
    assert assistant.converse(ws, s, "d", "what?") == {"answer": "Other", "tools": ["document", "pages"]}
    assert "Other words" in s.seen[-1] and "no tool fly" in s.seen[-1]
    assert assistant.converse(ws, Script(), "d", "what?", 3)["answer"] is None


def test_cached_vectors(spark, tmp_path):
    calls = []

    def encode(texts):
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("a", "xy"), ("b", "xyz"), ("c", None), ("d", "xy")], "k string, t string")
    path = str(tmp_path / "vectors")
    first = {r["k"]: r["vector"] for r in providers.cached_vectors(rows, "k", "t", path, "m", encode).collect()}
    assert first == {"a": [2.0, 1.0], "b": [3.0, 1.0], "c": None, "d": [2.0, 1.0]}
    n = spark.read.parquet(path).count()
    providers.cached_vectors(rows, "k", "t", path, "m", encode)
    assert spark.read.parquet(path).count() == n == 3 and not calls
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    with pytest.raises(RuntimeError):
        providers.cached_vectors(rows, "k", "t", path + "2", "m", encode)


def test_parents_are_summarised_from_below(spark):
    rows = [("d", "r", None, 0, None), ("d", "a", "r", 1, None), ("d", "b", "r", 2, "Second."), ("d", "x", "a", 3, "Leaf one. More."), ("d", "y", "a", 4, None)]
    df = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ord int, summary string")
    assert {r["node_id"]: r["summary"] for r in providers.parent_summaries(df).collect()} == {"r": "Leaf one.", "a": "Leaf one.", "b": "Second.", "x": "Leaf one. More.", "y": None}


def test_fields_levels_and_flags(spark):
    df = spark.createDataFrame([(1, json.dumps({"text": 1, "a": [{"text": 2, "b": {"text": 3, "c": 4}}]})), (2, "{cut"), (3, None)], "id int, j string")
    assert {r["id"]: r["j"] for r in trees.without_fields(df, "j", ("text",)).collect()} == {1: '{"a": [{"b": {"c": 4}}]}', 2: "{cut", 3: None}
    nodes = spark.createDataFrame([("d", "r", None, 0), ("d", "a", "r", 1), ("d", "b", "r", 2)], "doc_id string, node_id string, parent_id string, ord int")
    assert {(r["depth"], r["width"]) for r in trees.tree_levels(nodes).collect()} == {(1, 1), (2, 2)}
    assert {r["node_id"] for r in trees.with_children_flag(trees.with_paths(nodes)).where("has_children").collect()} == {"r"}
    assert trees.tree_levels(nodes.limit(0)).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", None, "q1", 1, 0.5, True), ("a", None, "q2", 0, None, False), ("b", "x", "q1", 1, 1.0, None)], "method string, model string, query_id string, correct_at_1 int, latency_seconds double, run_success boolean")
    got = {r["method"]: r for r in evaluation.config_aggregate(rows, ["method", "model"]).collect()}
    assert got["a"]["n_queries"] == 2 and got["a"]["accuracy_at_1_pct"] == 50.0 and got["a"]["avg_latency_seconds"] == 0.5 and got["a"]["successful_rows"] == 1 and got["a"]["avg_total_tokens"] is None
    left = spark.createDataFrame([("d1", 1), ("d2", 2)], "doc string, n int")
    right = spark.createDataFrame([("d1", 7, "y")], "name string, n int, z string")
    assert {tuple(r) for r in evaluation.join_named(left, right, {"doc": "name"}).collect()} == {("d1", 1, 7, "y"), ("d2", 2, None, None)}


def test_large_nodes_are_divided(spark):
    pages = [("d", p, f"{p} Part number {p}\n" + "word " * 30 if p % 3 == 1 else "word " * 30) for p in range(1, 13)]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    nodes = spark.createDataFrame([("d", "n0", None, 0, "1", "Part number 1", 1, 12), ("d", "n1", None, 1, "2", "Other", 12, 12)], "doc_id string, node_id string, parent_id string, ord int, structure string, title string, start_index int, end_index int")
    got = [(r["title"], r["parent_id"], r["start_index"], r["end_index"], r["ord"]) for r in toc.divided(nodes, df, token_count(F.col("text")), 10, 100).orderBy("ord").collect()]
    assert got == [("Part number 1", None, 1, 4, 0), ("Part number 4", "n0", 4, 7, 1), ("Part number 7", "n0", 7, 10, 2), ("Part number 10", "n0", 10, 12, 3), ("Other", None, 12, 12, 4)]
    assert toc.divided(nodes, df, token_count(F.col("text")), 20, 100).count() == 2


def test_titles_without_printed_pages(spark):
    toc_text = "Contents\nAlpha matters of the firm ........ 90\nBeta matters of the firm ........ 95\nGamma matters of the firm ........ 99\n"
    body = ["", "", "Alpha matters of the firm\nwords and more words here", "Beta matters of the firm\nwords and more words here", "Gamma matters of the firm\nwords and more words here"]
    pages = spark.createDataFrame([("d", 1, "Cover"), ("d", 2, toc_text)] + [("d", i + 1, t) for i, t in enumerate(body) if i >= 2], "doc_id string, page int, text string")
    got = [(r["title"], r["start_index"], r["mode"]) for r in toc.build_index(pages).orderBy("ord").collect()]
    assert [g[:2] for g in got if g[0] != "Preface"] == [("Alpha matters of the firm", 3), ("Beta matters of the firm", 4), ("Gamma matters of the firm", 5)]


def test_introductions_end_where_children_start(spark):
    pages = spark.createDataFrame([("d", 1, "Risk report\nWe face risks of many kinds."), ("d", 2, "More about them.\nCredit risk\nLoans may fail soon."), ("d", 3, "end")], "doc_id string, page int, text string")
    parents = spark.createDataFrame([("d", "p", "Risk report", None, 1), ("d", "q", "Nowhere", None, 2)], "doc_id string, node_id string, title string, start_phrase string, start_index int")
    kids = spark.createDataFrame([("d", "p", "Credit risk", "Loans may fail soon", 3), ("d", "q", "Unheard of", None, 3)], "doc_id string, parent_id string, title string, start_phrase string, start_index int")
    got = {r["node_id"]: (r["start_page"], r["end_page"], r["text"]) for r in sections.intro_texts(parents, kids, pages).collect()}
    assert got["p"] == (1, 2, "Risk report\nWe face risks of many kinds.\nMore about them.") and got["q"][2].startswith("More about them.")
    assert sections.intro_texts(parents.limit(0), kids, pages).count() == 0
    text = "Before\nCredit risk\nLoans may fail soon"
    assert sections.proximity_score(text, 7, "Credit risk", 19) == 100 + 90 - 0.6 and sections.proximity_score(text, 7, "Credit risk") == 100 and sections.proximity_score(text, 0, "Credit risk") == 0
    assert sections.line_score("3.2 Credit risk", "Credit risk") == 100 and sections.line_score("Credit risk is a part of all that we do in every year.", "Credit risk") == 10 and sections.line_score("All of credit risk", "Credit risk") == 20


def test_no_part_is_over_the_limit(spark):
    long = "one two three. " * 10 + "\n" + "w " * 50 + "\n\n" + "short para"
    parts = spark.createDataFrame([(long,), ("",), (None,)], "t string").select(F.explode(sections.packed_paragraphs(F.col("t"), 7)).alias("p")).select("p", token_count(F.col("p")).alias("n")).collect()
    assert max(r["n"] for r in parts) <= 7 and sum(r["n"] for r in parts) == 82
