import pytest
from pyspark.sql import functions as F

from leafmill.operators import trees

#      a
#     / \
#    b   e
#   / \
#  c   d
ROWS = [("x", "a", None, 0, "1", "A", 1, 9, None), ("x", "b", "a", 1, "1.1", "B", 1, 5, None), ("x", "c", "b", 2, "1.1.1", "C", 1, 2, "k1"), ("x", "d", "b", 3, "1.1.2", "D", 3, 2, "k2"), ("x", "e", "a", 4, "1.2", "E", 2, 9, "k3"), ("y", "a", None, 0, "1", "Solo", 1, 1, "k4")]
SCHEMA = "doc_id string, node_id string, parent_id string, ord int, structure string, title string, start_index int, end_index int, chunk_id string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_paths_leaves_closure(nodes):
    p = {(r["doc_id"], r["node_id"]): (r["depth"], r["path"]) for r in trees.with_paths(nodes).collect()}
    assert p["x", "d"] == (3, ["a", "b", "d"]) and p["y", "a"] == (1, ["a"])
    assert {(r["doc_id"], r["node_id"]) for r in trees.leaves(nodes).collect()} == {("x", "c"), ("x", "d"), ("x", "e"), ("y", "a")}
    got = {(r["doc_id"], r["node_id"]): (r["chunks"], r["unseen"]) for r in trees.descendant_chunks(nodes, nodes.where("chunk_id = 'k1'")).collect()}
    assert got["x", "a"] == (["k1", "k2", "k3"], 2) and got["x", "b"] == (["k1", "k2"], 1)
    paths = trees.with_paths(nodes)
    assert {r["node_id"] for r in trees.inherit_flag(paths, F.col("title") == "B").where("inherited").collect()} == {"b", "c", "d"}


def test_cycle_raises(spark):
    with pytest.raises(RuntimeError, match="cycle"):
        trees.with_paths(spark.createDataFrame([("x", "a", None, 0), ("x", "b", "c", 1), ("x", "c", "b", 2)], "doc_id string, node_id string, parent_id string, ord int"))


def test_numbering_and_collection(nodes):
    got = {(r["doc_id"], r["title"]): (r["node_id"], r["parent_id"]) for r in trees.numbered(nodes).collect()}
    assert got["x", "D"] == ("0003", "0001") and got["y", "Solo"] == ("0000", None)
    c = {r["node_id"]: (r["parent_id"], r["node_type"]) for r in trees.collection(nodes).collect()}
    assert c["x_c"] == ("x_b", "section") and c["x_a"] == ("x", "section") and c["x"] == ("collection", "document_node") and c["collection"] == (None, "collection_root")


def test_text_by_pages(spark, nodes):
    pages = spark.createDataFrame([("x", i, f"p{i}") for i in range(1, 10)], "doc_id string, page int, text string")
    got = {r["node_id"]: r["text"] for r in trees.node_text(nodes.where("doc_id = 'x'"), pages).collect()}
    assert got["c"] == "p1\np2" and "d" not in got
    assert {r["page"] for r in trees.page_images(nodes, ["c", "b"]).collect()} == {1, 2, 3, 4, 5}


def test_issues(spark, nodes):
    got = {(r["node_id"], r["issue"]) for r in trees.order_issues(trees.leaves(nodes)).collect()}
    assert got == {("d", "start_after_end"), ("e", "start_index_goes_backwards")}
    rows = spark.createDataFrame([("z", "1", None, 0, 1, 5), ("z", "2", None, 1, None, 7), ("z", "3", None, 2, 4, 8)], "doc_id string, node_id string, parent_id string, ord int, start_index int, end_index int")
    assert {(r["node_id"], r["issue"]) for r in trees.sibling_issues(rows).collect()} == {("2", "missing_index"), ("3", "start_before_previous_end")}


def test_spans_codes_and_headings(spark):
    items = spark.createDataFrame([("d", 0, 1, "yes", 9), ("d", 1, 3, "yes", 9), ("d", 2, 3, "no", 9)], "doc_id string, ord int, physical_index int, appear_start string, pages int")
    assert [(r["start_index"], r["end_index"]) for r in trees.page_spans(items).orderBy("ord").collect()] == [(1, 2), (3, 3), (3, 9)]
    codes = spark.createDataFrame([("d", 0, "1"), ("d", 1, "1.1"), ("d", 2, "2.1"), ("d", 3, None), ("d", 4, "1"), ("d", 5, "1.2"), ("d", 6, "2")], "doc_id string, ord int, structure string")
    assert {r["ord"]: r["parent_ord"] for r in trees.code_parents(codes).collect()} == {0: None, 1: 0, 2: None, 3: None, 4: None, 5: 4, 6: None}
    md = spark.createDataFrame([("d", "# A\nx y\n### B\n```\n# no\n```\n## C\nz"), ("e", None)], "doc_id string, text string")
    heads = trees.markdown_headings(md)
    assert [(r["level"], r["title"], r["line_num"]) for r in heads.orderBy("ord").collect()] == [(1, "A", 1), (3, "B", 3), (2, "C", 7)]
    assert {r["title"]: r["parent_ord"] for r in trees.heading_parents(heads).collect()} == {"A": None, "B": 1, "C": 1}
    tokens = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    assert {r["ord"]: r["subtree_tokens"] for r in trees.subtree_tokens(heads, tokens).collect()} == {1: 13, 2: 6, 3: 3}
    thin = {r["title"]: r["text"] for r in trees.thinned(heads, tokens, 100).collect()}
    assert list(thin) == ["A"] and thin["A"].count("\n") == 7
    assert {r["title"] for r in trees.thinned(heads, tokens, 7).collect()} == {"A", "B", "C"}


def test_edits(spark, nodes):
    ops = lambda *rows: spark.createDataFrame(rows, "doc_id string, op_no int, action string, node_id string, target_parent_id string, position string, reference_id string, start_index int, end_index int")
    out = trees.apply_corrections(nodes, ops(("x", 1, "move", "e", "b", "before", "d", None, None), ("x", 2, "remove", "c", None, None, None, None, None), ("x", 3, "update_indexes", "d", None, None, None, 7, 8), ("x", 4, "move", "b", "__root__", "first", None, None, None)))
    got = [(r["node_id"], r["parent_id"], r["start_index"]) for r in out.where("doc_id = 'x'").orderBy("ord").collect()]
    assert got == [("b", None, 1), ("e", "b", 2), ("d", "b", 7), ("a", None, 1)]
    assert out.where("doc_id = 'y'").count() == 1
    for bad in [("x", 1, "paint", "a", None, None, None, None, None), ("x", 1, "remove", "zz", None, None, None, None, None)]:
        with pytest.raises(Exception, match="unknown action|no node"):
            trees.apply_corrections(nodes, ops(bad)).collect()


def test_wrappers_and_siblings(spark):
    rows = [("d", "1", None, 0, None, "A", "p"), ("d", "2", "1", 1, None, "B", "q"), ("d", "3", "2", 2, None, "A", "p"), ("d", "4", "3", 3, None, "C", "r"), ("d", "5", "1", 4, "1.1", "S", None), ("d", "6", "1", 5, "1.1", "S2", "ph"), ("d", "7", "6", 6, "1.1.1", "T", None)]
    df = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ord int, structure string, title string, start_phrase string")
    lifted = {r["node_id"]: r["parent_id"] for r in trees.lift_wrappers(df).collect()}
    assert "3" not in lifted and lifted["4"] == "2"
    merged = {r["node_id"]: r for r in trees.merge_coded_siblings(df, ["title", "start_phrase"]).collect()}
    assert "6" not in merged and merged["5"]["start_phrase"] == "ph" and merged["5"]["title"] == "S" and merged["7"]["parent_id"] == "5"


def test_intro_and_pointers(spark, nodes):
    got = {r["node_id"]: (r["parent_id"], r["start_index"], r["end_index"]) for r in trees.with_intro_leaves(nodes).where("is_intro_node").collect()}
    assert got == {"a_intro": ("a", 1, 1), "b_intro": ("b", 1, 1)}
    rows = [("d", "c1", "1", "T", "ph", "x", 1), ("d", "c2", "1", "T", "ph", "y", 2), ("d", "c3", None, None, None, "same", 3), ("d", "c4", None, None, None, "same", 4), ("d", "c5", None, None, None, None, 5), ("e", "c6", "1", "T", "ph", "x", 1)]
    df = spark.createDataFrame(rows, "doc_name string, chunk_id string, structure string, title string, start_phrase string, text string, start_index int")
    got = {r["chunk_id"]: (r["canonical_id"], r["is_copy"]) for r in trees.point_duplicates(df).collect()}
    assert got == {"c1": ("c1", False), "c2": ("c1", True), "c3": ("c3", False), "c4": ("c3", True), "c5": ("c5", False), "c6": ("c6", False)}


def test_statistics(nodes):
    got = {r["doc_id"]: r for r in trees.tree_statistics(nodes, (1,)).collect()}
    assert (got["x"]["nodes"], got["x"]["leaves"], got["x"]["max_depth"], got["x"]["max_width"]) == (5, 3, 3, 2)
    assert abs(got["x"]["retained_1"] - (1 + 0.5 + 0.5) / 3) < 1e-9


def test_texts_that_differ_late_are_no_copies(spark):
    rows = [("d", "c1", None, None, None, "same " * 250 + "one", 1), ("d", "c2", None, None, None, "same " * 250 + "two", 2), ("d", "c3", None, None, None, "Same " * 250 + "one.", 3)]
    df = spark.createDataFrame(rows, "doc_name string, chunk_id string, structure string, title string, start_phrase string, text string, start_index int")
    assert {r["chunk_id"]: r["canonical_id"] for r in trees.point_duplicates(df).collect()} == {"c1": "c1", "c2": "c2", "c3": "c1"}
    assert {r["canonical_id"] for r in trees.point_duplicates(df, prefix=1000).collect()} == {"c1"}
