from leafmill.llm import encoding

CLEAN = ["Le comité d’éthique a dépassé le budget de l’année", "Die Größe der Rückstellung für das Geschäftsjahr", "A operação de crédito não excedeu", "przekroczył łączną kwotę", "The group’s value (§42) – worth €41 … is ± 3"]


def rows(spark):
    docs = [(i, t, "x") for i, t in enumerate(CLEAN * 6)]
    docs += [
        (100, encoding.misread(CLEAN[0], "cp1252"), "x"), (101, encoding.misread(CLEAN[1], "mac_roman"), "x"), (102, encoding.misread(encoding.misread(CLEAN[2], "cp1252"), "cp1252"), "x"),
        (103, encoding.swapped(CLEAN[1], "cp1252", "cp1251"), "x"), (104, "The group�s value", "x"), (105, encoding.misread("naïve œuvre", "cp1252"), "x"), (106, None, "x"), (107, "", "x"), (108, "Âmbito e São: à la §4, GESTÃO ±", "x"),
        (100, encoding.misread(CLEAN[0], "cp1252"), "again"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string, word string")


def test_found_and_restored(spark):
    df = rows(spark)
    found = {r["doc"] for r in encoding.garbled_documents(df).collect()}
    assert {100, 101, 102, 103, 104} <= found and not found & ({*range(len(CLEAN) * 6)} | {106, 107, 108})
    fixed = {r["doc"]: r["restored"] for r in encoding.restore(df).collect()}
    assert fixed[100] == CLEAN[0] and fixed[101] == CLEAN[1] and fixed[102] == CLEAN[2] and fixed[103] == CLEAN[1]
    assert fixed[104] == "The group’s value"


def test_forms_round_trip():
    for w in ("Größe", "d’éthique", "łączną", "€"):
        for e in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251"):
            form = encoding.misread(w, e)
            assert form in encoding.garbled_forms(w)
            back = encoding.TABLE[e][1]
            assert bytes(back[c] for c in form).decode() == w
    assert encoding.garbled_forms("plain") == {}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.garbled_documents(df).count() == 0
    assert encoding.restore(df).count() == 0


def test_control_characters_and_cyrillic(spark):
    docs = [(i, "The group’s value and цель группы компании") for i in range(30)]
    docs += [(100, "The group\x92s value"), (101, "a \x93quoted\x94 word"), (102, encoding.swapped("цель группы компании", "cp1251", "cp1252")), (103, "plain\x85text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    fixed = {r["doc"]: r["restored"] for r in encoding.restore(df).collect()}
    assert fixed == {100: "The group’s value", 101: "a “quoted” word", 102: "цель группы компании"}
