import json

from leafmill.operators import nested

RECORDS = {
    1: json.dumps([{"node_id": "a", "nodes": [{"node_id": "b", "children": {"node_id": "c"}}, None]}, {"node_id": "d", "parent_node_id": "b"}]),
    2: json.dumps({"doc_name": "x", "meta": {"builder": {"passes": [{"nodes": 1}], "name": "m"}}, "structure": [{"structure": "1", "title": "T", "sub_nodes": json.dumps([{"title": "U", "notes": [{"title": "n"}], "tags": ["p", None, "q"]}])}]}),
    3: json.dumps({"nodes": [{"node_id": 7, "parent_node_id": "8"}, {"node_id": "8", "parent_node_id": 8}, {"node_id": "9", "parent_node_id": "z"}, {"node_id": "9", "parent_node_id": "9"}, {"parent_node_id": None}]}),
    4: '[{"node_id": "cut',
    5: "",
    6: None,
    7: "[]",
    8: "12",
    9: json.dumps({"structure": None, "nodes": {"node_id": "only", "nodes": []}}),
    10: '{"nodes": [{"x": NaN}]}',
}


def frame(spark):
    rows = [(k, v, "e", 1) for k, v in RECORDS.items()] + [(1, RECORDS[1], "again", 2), (None, RECORDS[1], "", 3)]
    return spark.createDataFrame(rows, "tree_id long, structure string, record string, ord int")


def test_nodes_and_parents(spark):
    got = {(r["record"], r["node_ord"], r["parent_ord"]) for r in nested.node_table(nested.shred(frame(spark), "tree_id", "structure")).collect()}
    assert got == {(1, 0, -1), (1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 0, -1), (2, 1, 0), (3, 0, 1), (3, 1, -1), (3, 2, -1), (3, 3, 2), (3, 4, -1), (9, 0, -1)}


def test_tables_and_inlining(spark):
    rows = nested.shred(frame(spark), "tree_id", "structure").collect()
    tables = {(r["record"], r["table"], r["parent_table"], r["parent_ord"]) for r in rows}
    assert (2, "/notes", "node", 1) in tables and (2, "/passes", "record", 0) in tables
    top = next(r for r in rows if r["record"] == 2 and r["table"] == "record")
    assert top["fields"] == {"doc_name": "x", "meta.builder.name": "m"}
    assert [(r["pos"], r["fields"]["value"]) for r in rows if r["table"] == "/tags"] == [(0, "p"), (2, "q")]
    fields = nested.field_table(nested.shred(frame(spark), "tree_id", "structure"))
    assert fields.where("record = 2 AND name = 'title' AND table = '/notes'").first()["value"] == "n"


def test_inlining_rules():
    edges = [("record", "m", "m", 1), ("m", "b", "b", 1), ("record", "s", "s", 1), ("m", "s", "s", 1), ("record", "l", "l", 3), ("l", "r", "r", 1), ("r", "r", "r", 1)]
    assert nested.inlined(edges) == {("record", "m"), ("record", "m.b")}


def test_deep_and_empty(spark):
    deep = "[" + '{"nodes": [' * 400 + "]}" * 400 + "]"
    df = spark.createDataFrame([(1, deep)], "tree_id long, structure string")
    assert nested.node_table(nested.shred(df, "tree_id", "structure")).count() == 400
    assert nested.shred(df.limit(0), "tree_id", "structure").count() == 0


def test_keys_named_as_reserved_tables_are_no_nodes(spark):
    texts = [(1, json.dumps({"nodes": [{"title": "a", "node": {"x": 1}}]})), (2, json.dumps({"structure": [{"record": {"nodes": [{"y": 1}], "structure": [{"z": 2}]}}]}))]
    df = spark.createDataFrame(texts, "tree_id long, structure string")
    got = {(r["record"], r["node_ord"], r["parent_ord"]) for r in nested.node_table(nested.shred(df, "tree_id", "structure")).collect()}
    assert got == {(1, 0, -1), (2, 0, -1)}


def test_typed_tables(spark):
    texts = [(1, json.dumps({"v": 1, "meta": {"ok": True}, "nodes": [{"n": 1, "tags": [1, [2, 3]], "notes": [{"w": 1.5}, {"w": 2}]}]})), (2, json.dumps([{"n": "x"}]))]
    df = spark.createDataFrame(texts, "tree_id long, structure string")
    tables = nested.flat_tables(df, "tree_id", "structure")
    assert set(tables) == {"record", "node", "/tags", "/notes"}
    types = {t: {c: k for c, k in f.dtypes if c.startswith("f.")} for t, f in tables.items()}
    assert types == {"record": {"f.v": "bigint", "f.meta.ok": "boolean"}, "node": {"f.n": "string"}, "/tags": {"f.value": "bigint"}, "/notes": {"f.w": "double"}}
    assert [r["f.w"] for r in tables["/notes"].orderBy("ord").collect()] == [1.5, 2.0]
    assert sorted(r["f.value"] for r in tables["/tags"].where("`f.value` IS NOT NULL").collect()) == [1, 2, 3]
    assert set(nested.flat_tables(df.limit(0), "tree_id", "structure")) == {"record"}
