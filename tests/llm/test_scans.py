import random

from leafmill.llm import scans


def clean_corpus(n=400, seed=2):
    rng = random.Random(seed)
    subject = ["The reserve", "The million plan", "The committee", "The internal measurement", "The governance framework", "The short-dated portfolio"]
    verb = ["was reduced by", "increased to", "moved from", "is accrued at"]
    tail = ["million in the northern district", "percent of the insurance cover", "basis points under the terms of the settlement", "thousand for the consumer branch"]
    return [f"{rng.choice(subject)} {rng.choice(verb)} {rng.randint(100, 999)} {rng.choice(tail)}. {rng.choice(subject)} {rng.choice(verb)} {rng.randint(100, 999)} {rng.choice(tail)}." for _ in range(n)]


DIRTY = [
    ("h1", "The commit-\ntee moved from 120 percent of the insurance cover.", {"hyphen"}, "The committee moved from 120 percent of the insurance cover."),
    ("h2", "The govern¬ ance framework moved from 120 percent of the insurance cover.", {"hyphen"}, None),
    ("h3", "The short-\ndated portfolio moved from 120 percent of the insurance cover.", set(), None),
    ("h4", "The short- and million plan moved from 120 percent of the insurance cover.", set(), None),
    ("m1", "The internal measurernent was reduced by 120 rnillion in the northern district.", {"misread"}, "The internal measurement was reduced by 120 million in the northern district."),
    ("m2", "The reserve increased to l20 million in the northern district.", {"misread"}, "The reserve increased to 120 million in the northern district."),
    ("m3", "The sett lement increased to 120 million in the northern district.", {"misread"}, None),
    ("m4", "The ﬁrst reserve increased to 120 million in the northern district.", {"misread"}, None),
    ("p1", "The committee moved from 120 percent of the insurance\n\n17\nAcme Foods  Annual Report 2020\n\ncover.", {"header", "page_number"}, None),
    ("p2", "The committee moved from 120 percent of the insurance\nA C M E  F O O D S  A N D  S U B S I D I A R I E S\n[12]\ncover.", {"header", "page_number"}, None),
    ("p3", "The committee moved from 120 percent of the insurance cover and\nF-12\nof the settlement.", {"page_number"}, None),
    ("ok", "The reserve increased to 120 million in the northern district. See form 10-K, criterion E2-7, B2B and H2.", set(), None),
    ("t1", "(in millions)\n2020\n2019\nReserve\n372\n118\nPlan\n16\n944", set(), None),
]


def records(spark):
    rows = [(f"c{i}", "Acme_Foods_2020_AR_no-1", t, t[:30], "x") for i, t in enumerate(clean_corpus())]
    rows += [(k, "Acme_Foods_2020_AR_no-1", t, None, "y") for k, t, _, _ in DIRTY]
    # fragments and misreadings are seen elsewhere in a corpus, too
    rows += [("x1", None, "The sett lement was reduced by 140 percent.", "The sett lement was", "z"), ("nul", None, None, None, None), ("emp", "", "", "", None)]
    return spark.createDataFrame(rows, "chunk_id string, doc_name string, text string, start_phrase string, key string")


def test_kinds_and_repairs(spark):
    df = records(spark)
    got = {(r["key"], r["field"]): r for r in scans.repair_pages(df, "chunk_id", "doc_name", ["text", "start_phrase"]).collect()}
    for k, _, kinds, fixed in DIRTY:
        assert set(got[k, "text"]["kinds"]) == kinds, k
        if fixed:
            assert got[k, "text"]["text"] == fixed
    assert got["nul", "text"]["text"] is None and got["nul", "text"]["kinds"] == []
    assert got["emp", "text"]["text"] == ""
    assert not any(got[f"c{i}", "text"]["kinds"] for i in range(400))
    assert got["x1", "start_phrase"]["kinds"] == ["misread"]


def test_joined_model_gives_the_same_as_the_broadcast_one(spark):
    df = records(spark)
    model = scans.page_model(df, ["text", "start_phrase"])
    a = {tuple(map(str, r)) for r in scans.repair_pages(df, "chunk_id", "doc_name", ["text", "start_phrase"], model).collect()}
    b = {tuple(map(str, r)) for r in scans.repair_pages(df, "chunk_id", "doc_name", ["text", "start_phrase"], model, broadcast_rows=0).collect()}
    assert a == b


def test_found_and_empty(spark):
    df = records(spark)
    found = {tuple(r) for r in scans.found_debris(df).collect()}
    assert ("p1", "text", "header") in found and ("x1", "start_phrase", "misread") in found
    assert scans.found_debris(df.limit(0)).count() == 0


def test_distance_knows_look_alikes():
    assert scans.misread_cost("rnillion", "million") < 0.5
    assert scans.misread_cost("mi1lion", "million") < 0.5
    assert scans.misread_cost("ciosed", "closed") < 0.5
    assert scans.misread_cost("house", "mouse") == float("inf")
    assert scans.misread_cost("word", "word") == 0


def test_delete_variants_meet():
    assert scans.delete_variants("rnillion") & scans.delete_variants("million")
    assert scans.delete_variants("") == set()


def test_sentences_go_on_over_page_breaks():
    repair = scans.Repair({})
    text = {k: t for k, t, _, _ in DIRTY}
    whole = {
        "p1": "The committee moved from 120 percent of the insurance cover.",
        "p2": "The committee moved from 120 percent of the insurance cover.",
        "p3": "The committee moved from 120 percent of the insurance cover and of the settlement.",
    }
    for k, fixed in whole.items():
        assert repair.text(text[k], "Acme_Foods_2020_AR_no-1")[0] == fixed, k
    long = "The lending portfolio of the northern district, which the board of"
    for below in ("Directors met.", "12 members met.", "élus met."):
        assert repair.text(f"{long}\n\n- 17 -\n\n{below}", None)[0] == f"{long} {below}"
    # ended sentences, headings, items and table rows keep their breaks
    for above, below in [("The board met.", "The plan was set."), ("The Board Of The Plan", "As set out, it met."), ("The board met with the members of the plan and of the cover", "- an item"), ("Reserve   372   118", "Plan   16   944")]:
        assert repair.text(f"{above}\n\n- 17 -\n\n{below}", None)[0] == f"{above}\n\n{below}"


def test_wrapped_lines_go_on_before_capitals_and_digits():
    text = "Note 33\nIn the course of the transformation, the reserve at USD\n4,566.35 million was set and the share of the funds in\nSellowmere rose by 3 percent under the terms of\nthe plan.\nReserve of the plan\nAs set out, it fell."
    assert scans.paragraphs(text) == "Note 33\nIn the course of the transformation, the reserve at USD 4,566.35 million was set and the share of the funds in Sellowmere rose by 3 percent under the terms of the plan.\nReserve of the plan\nAs set out, it fell."


def test_amounts_stay_with_their_currency():
    assert scans.goes_on("the waste stream at USD", "5,590.3 million.", 0) and not scans.goes_on("USD", "2020", 0)


def test_every_pair_under_the_bound_is_a_candidate():
    for read, printed in [("lovv", "low"), ("rnilhon", "million"), ("rnethod0logy", "methodology"), ("staridpoirit", "standpoint")]:
        assert not scans.delete_variants(read) & scans.delete_variants(printed)
        assert printed in scans.printed_forms(read, 0.9) and scans.misread_cost(read, printed, 0.9) < 0.9
    assert "million" not in scans.printed_forms("million", 0.9) and not scans.printed_forms("a2c4e6", 0.9)


def test_twice_misread_and_torn_into_common_words(spark):
    rows = [(f"c{i}", None, t, None, "x") for i, t in enumerate(clean_corpus())]
    rows += [(f"b{i}", None, "The plan went on with care. The low cover is out of the plan. The low cover came out of the plan.", None, "x") for i in range(30)]
    rows += [(f"o{i}", None, "The plan was kept without recourse.", None, "x") for i in range(200)]
    bad = [("d1", "The lovv cover came out of the plan.", "The low cover came out of the plan."), ("d2", "The internal measurernerit was reduced by 120 rnilhon in the northern district.", "The internal measurement was reduced by 120 million in the northern district.")]
    bad += [("d3", "The plan was kept with out recourse.", "The plan was kept without recourse."), ("d5", "The low cover came to l5.9 million in the northern district.", "The low cover came to 15.9 million in the northern district."), ("d4", "The plan went with out of the plan.", "The plan went with out of the plan.")]
    df = spark.createDataFrame(rows + [(k, None, t, None, "y") for k, t, _ in bad], "chunk_id string, doc_name string, text string, start_phrase string, key string")
    model = scans.page_model(df, ["text", "start_phrase"])
    for how in ({}, {"broadcast_rows": 0}):
        got = {r["key"]: r["text"] for r in scans.repair_pages(df.where("key = 'y'"), "chunk_id", "doc_name", ["text"], model, **how).collect()}
        assert got == {k: fixed for k, _, fixed in bad}


def test_joined_model_follows_its_answers(spark):
    model = {"v:measurement": "50||", "c:mea-surernent": "2", "v:measurernent": "0|measurement|", "v:fiscai": "0|fiscal|", "v:fiscal": "50||", "t:sett lement": "", "v:sett": "0||f", "v:lement": "0||f", "v:shareholder": "20||", "v:outcome": "30||", "v:outcorne": "0|outcome|"}
    rows = [("a", "The mea-\nsurernent rose."), ("b", "The ﬁscai reserve rose."), ("c", "The long reserve of the plan and the sett\n\n- 17 -\n\nlement rose."), ("d", "Each share-\nF-12\nholder votes the share."), ("e", "The out-\ncorne was")]
    df = spark.createDataFrame([(k, None, t) for k, t in rows], "chunk_id string, doc_name string, text string")
    known = spark.createDataFrame([(k, v, 1) for k, v in model.items()], "key string, value string, n long")
    a, b = ({r["key"]: (r["kinds"], r["text"]) for r in scans.repair_pages(df, "chunk_id", "doc_name", ["text"], known, **how).collect()} for how in ({}, {"broadcast_rows": 0}))
    assert a == b and [a[k][1] for k in "abcde"] == ["The measurement rose.", "The fiscal reserve rose.", "The long reserve of the plan and the settlement rose.", "Each shareholder votes the share.", "The outcome was"]


def debris(rng, text):
    """A clean text with random debris."""
    w = text.split(" ")
    for _ in range(rng.randint(0, 5)):
        i = rng.randrange(len(w))
        x = w[i]
        how = rng.randrange(7)
        if how == 0 and len(x) > 4:
            w[i] = x[: len(x) // 2] + rng.choice("-¬=") + rng.choice(["\n", " ", "\nF-12\n", "\n\n[3]\nAcme Foods\n"]) + x[len(x) // 2 :]
        elif how == 1:
            w[i] = x.replace("m", "rn").replace("l", "1")
        elif how == 2 and len(x) > 5:
            w[i] = x[:3] + " " + x[3:]
        elif how == 3:
            w[i] = x + rng.choice(["\n\n- 7 -\n", "\n- 17 -\nRemuneration Report 2021\n", " F-9 Remuneration Report 2021 "])
        elif how == 4:
            w[i] = x.replace("fi", "ﬁ").replace("i", "l")
        elif how == 5:
            w[i] = x[: len(x) // 2] + "-\n" + x[len(x) // 2 :].replace("m", "rn").replace("n", "ri")
        else:
            w[i] = x + "\n"
    return " ".join(w)


def test_any_part_of_the_model_may_be_joined(spark):
    rng = random.Random(11)
    clean = clean_corpus(300, 5)
    rows = [(f"c{i}", "Acme_Foods_2020_AR_no-1", t, t[:30]) for i, t in enumerate(clean)] + [(f"d{i}", "Acme_Foods_2020_AR_no-1", debris(rng, t), debris(rng, t[:40])) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_name string, text string, start_phrase string")
    model = scans.page_model(df, ["text", "start_phrase"])
    assert "h:remuneration report" in {r["key"] for r in model.collect()}
    out = []
    for most in (500_000, 60, 0):
        got = scans.repair_pages(df, "chunk_id", "doc_name", ["text", "start_phrase"], model, broadcast_rows=most).collect()
        out.append({(r["key"], r["field"]): (tuple(r["kinds"]), r["text"]) for r in got})
    assert out[0] == out[1] == out[2]
    assert sum("hyphen" in k for k, _ in out[0].values()) > 20 and sum("header" in k for k, _ in out[0].values()) > 20


def test_running_titles_are_found_by_recurrence():
    lines = [f"The plan rose.\nF-{i}\nProxy Statement 20{i}\nThe cover fell." for i in range(10, 14)] + ["S A F E T Y  R E P O R T  2 0 2 0  |  A C M E\n[7]", "Plan Cost\n2020\n17"]
    got = [t for x in lines for t in scans._title_lines(x)]
    assert got.count(("proxy statement", True, True)) == 4 and ("safety report", True, True) in got and ("plan cost", False, True) in got
    repair = scans.Repair({"h:proxy statement": "", "v:proxy": "0||T"})
    assert repair.text("The plan of the\nPROXY STATEMENT 2021\n12\ncover fell.", None) == ("The plan of the cover fell.", {"header", "page_number"})
    assert repair.text("The plan of the\nP R O X Y  S T A T E M E N T  2 0 2 1\ncover fell.", None) == ("The plan of the cover fell.", {"header"})
    assert repair.text("The cover of the proxy statement fell.", None)[1] == set()
    assert repair.text("The plan of the\nGlobex Corporation Remuneration Overview 2021\nF-3\ncover fell.", "Globex_Corporation_2021_x")[0] == "The plan of the cover fell."
