import pytest
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.functions.words import token_count, word_array, words


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [("  1.2 Ofﬁce Space!", "12officespace"), (None, None), ("", ""), ("é", "")])
def test_match_key(spark, value, want):
    assert one(spark, value, text.match_key) == want


def test_keys_and_ids(spark):
    assert one(spark, " 12 Café-Bar", text.heading_key) == "cafbar"
    assert one(spark, "  A--b  C ", text.word_key) == "a b c"
    assert one(spark, "/x/3M 2018-10K_structure_new.json", text.clean_doc_id) == "3M_2018_10K"
    assert one(spark, "/x/A_b.pdf", text.clean_title) == "A b"


def test_tokens(spark):
    assert one(spark, "The well-known A, a  B's cat! cat", text.bm25_tokens) == ["wellknown", "bs", "cat", "cat"]
    assert one(spark, None, text.bm25_tokens) == []
    assert one(spark, "a\tb \n c", token_count) == 3 and one(spark, None, token_count) == 0
    for t in ("Ab-c 12 d_e É1", "", "  ", "ß Straße"):
        assert one(spark, t, word_array) == words(t)


def test_numbers_and_coverage(spark):
    assert one(spark, "$55,893 and (5,022) fell -14.76%, 7 7", text.numbers) == ["55893", "(5022)", "-14.76%", "7", "7"]
    df = spark.createDataFrame([(["7", "7", "8"], ["7", "9"]), ([], ["1"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(text.multiset_coverage(F.col("a"), F.col("b"))).collect()] == [0.3333, 1.0]


def test_pages(spark):
    assert one(spark, "5-7, 3,6", text.parse_pages) == [3, 5, 6, 7]
    assert one(spark, "7-5", text.parse_pages) is None and one(spark, "x", text.parse_pages) is None and one(spark, None, text.parse_pages) is None


def test_replies(spark):
    assert one(spark, '```json\n{"a": [1,\n2,],}\n```', text.fenced_json) == '{"a": [1, 2]}'
    assert one(spark, "<physical_index_12>", text.physical_index) == 12 and one(spark, "page", text.physical_index) is None
    assert [one(spark, x, text.yes_no) for x in (" Yes ", "absent", "Maybe ", None)] == ["Present", "No TOC", "maybe", ""]


def test_predicates(spark):
    table = "\n".join("Row   %d   12%%   3" % i for i in range(5))
    plain = lambda t, title=None: spark.createDataFrame([(title, None, t)], "t string, h string, x string").select(text.is_table_like(F.col("t"), F.col("h"), F.col("x"))).first()[0]
    assert plain(table) is True and plain("Plain text.") is False and plain("Plain text.", "EU KM1 – Template") is True and plain(None) is False
    assert one(spark, "- 12 -", text.is_nearly_blank) is True and one(spark, "x" * 40, text.is_nearly_blank) is False
    df = spark.createDataFrame([("Introduction", "c1", None, None), ("An introduction", "", "", False), ("Risk", None, None, True), ("Risk", "x_intro", "n", None), (None, None, None, None)], "t string, c string, n string, f boolean")
    assert [r[0] for r in df.select(text.is_intro(F.col("t"), F.col("c"), F.col("n"), F.col("f"))).collect()] == [False, True, True, True, False]
    lines = "a b c d e f g\n- - - -\n12 345 rows of it\nplain line\n12%   3\n\n1,234,567,890"
    assert round(one(spark, lines, text.table_score), 6) == round(5 / 6, 6) and one(spark, None, text.table_score) == 0.0
    assert one(spark, ["b", "", None, "a", "b"], text.distinct_in_order, "array<string>") == ["b", "a"]


def test_context_and_times(spark):
    df = spark.createDataFrame([(["a", " ", "c"],)], "x array<string>")
    assert df.select(text.context_text(F.col("x"))).first()[0] == "[Retrieved chunk 1]\na\n\n[Retrieved chunk 3]\nc"
    assert str(one(spark, "2024-01-02T03:04:05", text.run_time)) == "2024-01-02 03:04:05" and one(spark, "n/a", text.run_time) is None


def test_first_nonempty_and_query_id(spark):
    df = spark.createDataFrame([("", "d", "g", "q"), ("f", "d", "g", "q"), (None, "d", "", "q")], "f string, d string, g string, q string")
    got = [r[0] for r in df.select(text.query_id(*(F.col(c) for c in "fdgq"))).collect()]
    assert got[:2] == ["d__g__q", "f"] and len(got[2]) == 16
