"""Queries of problem 5: section trees as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import nested
from leafmill.plans.queries import Registry
from leafmill.session import table

REGISTRY = Registry()
query = REGISTRY.query


# the trees of complete records as rows: children under any of their keys, also written as JSON text
OPEN = "CASE WHEN json_type({0}) IN ('ARRAY', 'OBJECT') THEN {0} WHEN json_type({0}) = 'VARCHAR' AND json_valid({0}->>'$') AND json_type(({0}->>'$')::JSON) IN ('ARRAY', 'OBJECT') THEN ({0}->>'$')::JSON END"
ENTRIES = "CASE WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') WHEN json_type({0}) = 'OBJECT' THEN [{0}] ELSE [] END"
NODES_SQL = f"""
WITH RECURSIVE r AS (SELECT tree_id, max(structure) AS s FROM trees WHERE structure IS NOT NULL AND tree_id IS NOT NULL GROUP BY tree_id),
v AS (SELECT tree_id, s::JSON AS j FROM r WHERE json_valid(s)),
a AS (SELECT tree_id, j, j->'structure' AS x, j->'nodes' AS y FROM v),
t AS (SELECT tree_id, CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE coalesce({OPEN.format('x')}, {OPEN.format('y')}) END AS l FROM a),
n AS (SELECT tree_id, [i] AS path, NULL::BIGINT[] AS up, x AS node FROM (SELECT tree_id, unnest({ENTRIES.format('l')}) AS x, generate_subscripts({ENTRIES.format('l')}, 1) AS i FROM t) WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT tree_id, list_concat(path, [p, i]), path, x FROM (SELECT tree_id, path, p, unnest({ENTRIES.format('o')}) AS x, generate_subscripts({ENTRIES.format('o')}, 1) AS i
    FROM (SELECT tree_id, path, p, {OPEN.format('c')} AS o FROM (SELECT tree_id, path, p, json_extract(node, '$."' || k || '"') AS c FROM (SELECT tree_id, path, node, unnest(json_keys(node)) AS k, generate_subscripts(json_keys(node), 1) AS p FROM n) WHERE k IN ('nodes', 'children', 'sub_nodes')))) WHERE json_type(x) = 'OBJECT'),
m AS (SELECT tree_id, path, up, node, node->>'$.node_id' AS nid, node->>'$.parent_node_id' AS pid, (row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1)::INT AS node_ord FROM n),
q AS (SELECT m.tree_id, m.path, count(o.path) AS k, min(o.node_ord) AS o FROM m JOIN m o ON o.tree_id = m.tree_id AND o.nid = m.pid AND o.path <> m.path WHERE m.up IS NULL GROUP BY ALL),
nodes AS (SELECT m.tree_id, m.node_ord, coalesce(e.node_ord, CASE WHEN q.k = 1 THEN q.o END, -1) AS parent_ord, m.up IS NOT NULL AS nested, m.node FROM m LEFT JOIN m e ON e.tree_id = m.tree_id AND e.path = m.up LEFT JOIN q ON q.tree_id = m.tree_id AND q.path = m.path)
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(table(spark, d, "trees"), "tree_id", "structure")


@query("p5_found", NODES_SQL + "SELECT tree_id, node_ord, parent_ord FROM nodes")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.shred(table(spark, d, "trees"), "tree_id", "structure", with_fields=False)
    return nested.node_table(rows).select(F.col("record").alias("tree_id"), "node_ord", "parent_ord")


_TEXTS = ["node_id", "structure", "title", "heading", "start_phrase", "summary", "chunk_id"]
_NUMBERS = ["start_index", "end_index", "text_token_count"]
_SCALAR_SQL = "CASE WHEN json_type(node->'$.{0}') NOT IN ('ARRAY', 'OBJECT') THEN node->>'$.{0}' END"


@query(
    "p5_nodes",
    NODES_SQL
    + "SELECT tree_id, node_ord, parent_ord, nested, "
    + ", ".join(f"{_SCALAR_SQL.format(c)} AS {c}" for c in _TEXTS)
    + ", "
    + ", ".join(f"TRY_CAST(nullif(regexp_extract({_SCALAR_SQL.format(c)}, '([0-9]+)', 1), '') AS INT) AS {c}" for c in _NUMBERS)
    + " FROM nodes",
)
def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with their usual fields as columns; page numbers are the digits of what was written."""
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract(fields['{c}'], '([0-9]+)', 1), '') AS int)").alias(c)
    nodes = nested.node_table(_rows(spark, d))
    return nodes.select(F.col("record").alias("tree_id"), "node_ord", "parent_ord", "nested", *(F.col("fields")[c].alias(c) for c in _TEXTS), *(number(c) for c in _NUMBERS))


@query("p5_fields")
def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    return nested.field_table(_rows(spark, d)).withColumnRenamed("record", "tree_id")
