import re

from leafmill.llm import splitting

TOKEN = re.compile(r"[^ \t\r\n]+")


def texts():
    w = lambda n, s="w": " ".join(f"{s}{i}" for i in range(n))
    return {
        "fits": w(50),
        "para": "\n\n".join(w(30, f"p{i}_") + "." for i in range(6)),
        "line": "\n".join(w(30, f"l{i}_") for i in range(6)),
        "blanks": (w(30) + "\n \t \n") * 5,
        "word": w(260),
        "crlf": "\r\n\r\n".join(w(40, f"c{i}_") for i in range(4)),
        "mixed": w(30) + "\n\n" + w(120, "m") + ". " + w(20, "n"),
    }


def test_pieces_keep_limit_words_and_overlap(spark):
    rows = [(k, t, "x") for k, t in texts().items()] + [("fits", texts()["fits"], "again"), ("nul", None, ""), ("emp", "", ""), ("bl", " \n\t ", "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, id string")
    out = splitting.split_oversized(df, limit=100, overlap=10, only_oversized=False).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["id"], r["piece"])):
        by.setdefault(r["id"], []).append(r)
    assert set(by) == set(texts())
    for k, t in texts().items():
        own = []
        for i, r in enumerate(by[k]):
            tokens = TOKEN.findall(r["text"])
            assert len(tokens) == r["word_count"] <= 100 and r["piece"] == i and r["pieces"] == len(by[k])
            assert r["overlap_words"] == (10 if i else 0)
            if i:
                assert tokens[:10] == before[-10:]
            before = tokens  # noqa: F841
            own += tokens[r["overlap_words"] :]
        assert own == TOKEN.findall(t), k
    assert {k: v[0]["boundary"] for k, v in by.items()} == {"fits": None, "para": "paragraph", "line": "line", "blanks": "paragraph", "word": "word", "crlf": "paragraph", "mixed": "word"}


def test_cuts_stand_at_blank_lines(spark):
    df = spark.createDataFrame([("para", texts()["para"])], "chunk_id string, text string")
    out = splitting.split_oversized(df, limit=70, overlap=0).orderBy("piece").collect()
    assert len(out) == 3 and all(r["text"].endswith(".") for r in out)


def test_very_long_texts_and_words(spark):
    t = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([("long", t), ("one", "x" * 50_000 + " " + " ".join("y" * 3 for _ in range(900)))], "chunk_id string, text string")
    out = splitting.split_oversized(df, overlap=0).groupBy("id").sum("word_count").collect()
    got = {r[0]: r[1] for r in out}
    assert got["long"] == 60_000 and got["one"] == 905


def test_empty(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert splitting.split_oversized(df).count() == 0


def test_limits_do_not_deepen_the_stack(spark):
    t = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([("long", t)], "chunk_id string, text string")
    for limit in (800, 8_000, 30_000):
        out = splitting.split_oversized(df, limit=limit, overlap=0).orderBy("piece").collect()
        assert [r["word_count"] for r in out] == [limit] * (60_000 // limit) + [60_000 % limit] * (60_000 % limit > 0)


def test_longest_pieces_are_cut_at_the_strongest_boundary(spark):
    t = "a b c. d e\nf g h. i j k l m n o p"
    df = spark.createDataFrame([("t", t)], "chunk_id string, text string")
    got = [r["text"] for r in splitting.split_oversized(df, limit=6, overlap=0, least=2).orderBy("piece").collect()]
    assert got == ["a b c. d e", "f g h.", "i j k l m n", "o p"]
