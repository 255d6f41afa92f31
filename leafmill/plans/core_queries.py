"""Queries over the chunk store, trees, evidence, questions and runs, each with its SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.functions import providers, text
from leafmill.functions.words import token_count, word_array
from leafmill.operators import answers, evaluation, matching, navigator, nested, retrieval, trees
from leafmill.plans.nested_queries import NODES_SQL
from leafmill.plans.queries import Registry
from leafmill.session import cleared, materialise, table
from leafmill.streaming import results

REGISTRY = Registry()
query = REGISTRY.query

CURRENT_SQL = "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS FIRST) = 1)"
EVIDENCE_SQL = "ev AS (SELECT * FROM evidence_report QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY matched_at DESC NULLS FIRST) = 1)"
CLEAN_ID_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^.*[/\\]', ''), '\.(?:pdf|json|jsonl|md|csv)$', ''), '(?:_structure_new|_structure|_chunks)$', ''), '[^A-Za-z0-9]+', '_', 'g')"
MATCH_KEY_SQL = "regexp_replace(replace(replace(lower({0}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^a-z0-9]', '', 'g')"
WORDS_SQL = r"len(regexp_extract_all(coalesce({0}, ''), '[^ \t\r\n]+'))"


def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their latest delivery."""
    return evaluation.keep_latest(table(spark, d, "chunks"), ["chunk_id"], F.col("ingested_at"))


def current_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.keep_latest(table(spark, d, "evidence_report"), ["evidence_id"], F.col("matched_at"))


# ------------------------------------------------------------------------------------ scalar functions
@query(
    "sc_keys",
    f"""WITH {CURRENT_SQL} SELECT chunk_id, {MATCH_KEY_SQL.format('title')} AS match_key, {MATCH_KEY_SQL.format(r"regexp_replace(title, '^\s*\d+\s*', '')")} AS heading_key,
trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS word_key, regexp_replace({CLEAN_ID_SQL.format('doc_name')}, '^_+|_+$', '', 'g') AS doc_id, {WORDS_SQL.format('text')} AS tokens FROM cur""",
)
def sc_keys(spark: SparkSession, d: str) -> DataFrame:
    return current_chunks(spark, d).select("chunk_id", text.match_key(F.col("title")).alias("match_key"), text.heading_key(F.col("title")).alias("heading_key"), text.word_key(F.col("title")).alias("word_key"), text.clean_doc_id(F.col("doc_name")).alias("doc_id"), token_count(F.col("text")).cast("long").alias("tokens"))


@query(
    "sc_numbers",
    rf"""WITH {EVIDENCE_SQL}, n AS (SELECT evidence_id, list_transform(regexp_extract_all(coalesce(evidence_text, ''), '\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?'), lambda x: regexp_replace(x, '[$,]', '', 'g')) AS n FROM ev)
SELECT evidence_id, len(n) AS how_many, array_to_string(n, '|') AS numbers FROM n""",
)
def sc_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = current_evidence(spark, d).select("evidence_id", text.numbers(F.col("evidence_text")).alias("n"))
    return n.select("evidence_id", F.size("n").cast("long").alias("how_many"), F.array_join("n", "|").alias("numbers"))


@query(
    "pf_predicates",
    rf"""WITH {CURRENT_SQL}, k AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS tk, trim(regexp_replace(lower(coalesce(heading, '')), '[^a-z0-9]+', ' ', 'g')) AS hk, trim(regexp_replace(lower(left(coalesce(text, ''), 500)), '[^a-z0-9]+', ' ', 'g')) AS xk,
  list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM cur),
l AS (SELECT *, ls[1:80] AS l80, len(list_filter(ls, lambda x: regexp_matches(x, '(?i)^(?:[a-z]{{1,2}}\s+){{5,}}[a-z]{{1,2}}$')
    OR len(regexp_extract_all(x, '\d')) >= 8 OR len(regexp_extract_all(x, '%')) >= 3 OR (regexp_matches(x, '\S\s{{3,}}\S') AND (len(regexp_extract_all(x, '\d')) >= 2 OR contains(x, '%')))
    OR (regexp_matches(x, '^\d{{1,3}}\s') AND len(regexp_extract_all(x, '\d')) >= 3 AND len(regexp_extract_all(x, '\S+')) <= 25)
    OR list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN x[i] = '-' AND NOT regexp_matches(coalesce(nullif(x[i - 1], ''), ' '), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(coalesce(nullif(x[i + 1], ''), ' '), '[\p{{L}}\p{{N}}_]') THEN 1 ELSE 0 END)) >= 4)) / nullif(len(ls), 0) AS score FROM k),
r AS (SELECT *, len(list_filter(l80, lambda x: regexp_matches(x, '\d'))) / nullif(len(l80), 0) AS a, len(list_filter(l80, lambda x: regexp_matches(x, '\s{{3,}}'))) / nullif(len(l80), 0) AS b, len(list_filter(l80, lambda x: contains(x, '%'))) / nullif(len(l80), 0) AS c,
  list_has_any(string_split(tk || ' ' || hk, ' '), ['table', 'template']) AS named FROM l)
SELECT chunk_id,
  coalesce(is_intro_node, false) OR contains(lower(chunk_id), 'intro') OR contains(lower(coalesce(node_id, '')), 'intro') OR contains(lower(coalesce(title, '')), ' introduction') AS is_intro,
  regexp_matches(concat_ws(' ', tk, hk, xk), 'appendix|annex|glossary|assurance report|limited assurance|independent auditor|table of contents|contents|index') AS is_appendix,
  named OR (coalesce(a, 0) > 0.65 AND (coalesce(b, 0) > 0.25 OR coalesce(c, 0) > 0.20)) AS is_table,
  length(trim(regexp_replace(coalesce(text, ''), '[\d\s.\-–—]', '', 'g'))) < 30 AS is_blank,
  round(coalesce(score, 0), 6) AS table_score,
  named OR coalesce((token_count > 1500 AND coalesce(score, 0) > 0.18) OR (token_count > 3000 AND coalesce(score, 0) > 0.12), false) AS is_large_table FROM r""",
)
def pf_predicates(spark: SparkSession, d: str) -> DataFrame:
    c = current_chunks(spark, d)
    title, heading, body = F.col("title"), F.col("heading"), F.col("text")
    return c.select(
        "chunk_id", text.is_intro(title, F.col("chunk_id"), F.col("node_id"), F.col("is_intro_node")).alias("is_intro"), text.is_appendix(title, heading, body).alias("is_appendix"), text.is_table_like(title, heading, body).alias("is_table"),
        text.is_nearly_blank(body).alias("is_blank"), F.round(text.table_score(body), 6).alias("table_score"), text.is_large_table(title, heading, body, F.col("token_count")).alias("is_large_table"),
    )


@query("pf_canonical", f"WITH {CURRENT_SQL} SELECT chunk_id FROM cur WHERE NOT coalesce(is_duplicate_chunk, false)")
def pf_canonical(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.canonical(current_chunks(spark, d)).select("chunk_id")


@query(
    "pf_pages",
    f"""WITH {CURRENT_SQL}, s AS (SELECT chunk_id, generate_series(start_index, end_index) AS p FROM cur WHERE start_index <= end_index)
SELECT chunk_id, len(p) AS pages, list_min(p) AS first_page, list_max(p) AS last_page FROM s""",
)
def pf_pages(spark: SparkSession, d: str) -> DataFrame:
    p = current_chunks(spark, d).select("chunk_id", text.parse_pages(F.concat_ws("-", "start_index", "end_index")).alias("p"), "start_index", "end_index").where("p IS NOT NULL AND start_index IS NOT NULL AND end_index IS NOT NULL")
    return p.select("chunk_id", F.size("p").cast("long").alias("pages"), F.array_min("p").alias("first_page"), F.array_max("p").alias("last_page"))


@query(
    "sc_query_ids",
    """SELECT DISTINCT query_id, coalesce(nullif(financebench_id, ''), nullif(CASE WHEN coalesce(ground_truth_chunk_id, '') <> '' THEN concat_ws('__', nullif(doc_name, ''), nullif(ground_truth_chunk_id, ''), nullif(query, '')) END, ''), left(sha1(query), 16)) AS key FROM queries""",
)
def sc_query_ids(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.select("query_id", text.query_id(F.col("financebench_id"), F.col("doc_name"), F.col("ground_truth_chunk_id"), F.col("query")).alias("key")).distinct()


# -------------------------------------------------------------------------------------- trees and edits
def _leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the leaves of their documents, in the order of their ids."""
    w = Window.partitionBy("doc_name").orderBy("chunk_id")
    return current_chunks(spark, d).select(F.col("doc_name").alias("doc_id"), F.col("chunk_id").alias("node_id"), F.row_number().over(w).alias("ord"), "structure", "title", "heading", "start_index", "end_index")


LEAVES_SQL = f"WITH {CURRENT_SQL}, lf AS (SELECT doc_name AS doc_id, chunk_id AS node_id, row_number() OVER (PARTITION BY doc_name ORDER BY chunk_id) AS ord, structure, heading, start_index, end_index FROM cur)"


@query(
    "te_order_issues",
    LEAVES_SQL
    + """, g AS (SELECT *, start_index IS NOT NULL AND end_index IS NOT NULL AS good FROM lf),
p AS (SELECT *, last_value(CASE WHEN good THEN start_index END IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN good THEN end_index END IGNORE NULLS) OVER w AS pe FROM g
  WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, node_id, 'missing_index' AS issue FROM p WHERE NOT good
UNION ALL SELECT doc_id, node_id, 'start_after_end' FROM p WHERE good AND start_index > end_index
UNION ALL SELECT doc_id, node_id, 'start_index_goes_backwards' FROM p WHERE good AND start_index < ps
UNION ALL SELECT doc_id, node_id, 'start_before_previous_end' FROM p WHERE good AND start_index < pe""",
)
def te_order_issues(spark: SparkSession, d: str) -> DataFrame:
    return trees.order_issues(_leaf_rows(spark, d)).select("doc_id", "node_id", "issue")


@query(
    "te_duplicates",
    f"""WITH {CURRENT_SQL}, k AS (SELECT chunk_id, doc_name, start_index, nullif({MATCH_KEY_SQL.format('structure')}, '') AS s, nullif({MATCH_KEY_SQL.format('title')}, '') AS t, nullif({MATCH_KEY_SQL.format('start_phrase')}, '') AS p, nullif({MATCH_KEY_SQL.format('left(text, 1000)')}, '') AS x FROM cur),
q AS (SELECT *, CASE WHEN s IS NOT NULL AND t IS NOT NULL AND p IS NOT NULL THEN 'stp|' || s || '|' || t || '|' || p WHEN s IS NOT NULL AND t IS NOT NULL THEN 'st|' || s || '|' || t WHEN x IS NOT NULL THEN 'x|' || x ELSE 'id|' || chunk_id END AS k FROM k)
SELECT chunk_id, first_value(chunk_id) OVER (PARTITION BY doc_name, k ORDER BY start_index NULLS FIRST, chunk_id) AS canonical_id FROM q""",
)
def te_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return trees.point_duplicates(current_chunks(spark, d)).select("chunk_id", "canonical_id")


@query(
    "tc_code_parents",
    LEAVES_SQL
    + r""", u AS (SELECT *, nullif(regexp_extract(structure, '^(.*)\.[^.]*$', 1), '') AS up FROM lf)
SELECT u.doc_id, u.ord, max(p.ord) AS parent_ord FROM u LEFT JOIN u p ON p.doc_id = u.doc_id AND p.structure = u.up AND p.ord < u.ord GROUP BY ALL""",
)
def tc_code_parents(spark: SparkSession, d: str) -> DataFrame:
    return trees.code_parents(_leaf_rows(spark, d)).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("parent_ord").cast("long").alias("parent_ord"))


@query(
    "tc_page_spans",
    LEAVES_SQL
    + """, n AS (SELECT doc_id, max(end_index) AS pages FROM lf GROUP BY doc_id), l AS (SELECT lf.*, n.pages, lead(start_index) OVER w AS nxt, lead(CASE WHEN heading IS NULL THEN 'no' ELSE 'yes' END) OVER w AS st FROM lf JOIN n USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, start_index, CASE WHEN nxt IS NULL THEN pages WHEN st = 'yes' THEN nxt - 1 ELSE nxt END AS end_index FROM l""",
)
def tc_page_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = _leaf_rows(spark, d)
    last = rows.groupBy("doc_id").agg(F.max("end_index").alias("pages"))
    items = rows.select("doc_id", "ord", F.col("start_index").alias("physical_index"), F.when(F.col("heading").isNull(), "no").otherwise("yes").alias("appear_start")).join(last, "doc_id")
    return trees.page_spans(items).select("doc_id", F.col("ord").cast("long").alias("ord"), "start_index", "end_index")


@query(
    "tr_page_load",
    f"WITH {CURRENT_SQL}, s AS (SELECT doc_name AS doc_id, unnest(generate_series(start_index, end_index)) AS page FROM cur WHERE start_index <= end_index) SELECT doc_id, page, count(*) AS chunks FROM s GROUP BY ALL",
)
def tr_page_load(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks touch each page: the range join of spans and pages as an equi-join."""
    rows = current_chunks(spark, d).where("start_index <= end_index")
    return rows.select(F.col("doc_name").alias("doc_id"), F.explode(F.sequence(F.col("start_index").cast("long"), F.col("end_index").cast("long"))).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("chunks"))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each document's latest tree as ``doc_id, node_id, parent_id, ord, ...`` (ids: places in the record)."""
    latest = evaluation.keep_latest(table(spark, d, "trees"), ["doc_name"], F.struct("built_at", "tree_id"))
    rows = nested.node_table(nested.shred(latest, "tree_id", "structure"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract(fields['{c}'], '([0-9]+)', 1), '') AS int)").alias(c)
    own = rows.join(latest.select(F.col("tree_id").alias("record"), F.col("doc_name").alias("doc_id"), "doc_description"), "record")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    return own.select("doc_id", "doc_description", name("node_ord").alias("node_id"), F.when(F.col("parent_ord") >= 0, name("parent_ord")).alias("parent_id"), F.col("node_ord").alias("ord"), *(F.col("fields")[c].alias(c) for c in ("structure", "title", "summary", "chunk_id")), number("start_index"), number("end_index"))


TREE_SQL = (
    NODES_SQL
    + """, lt AS (SELECT tree_id, doc_name, doc_description FROM trees QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY built_at DESC NULLS LAST, tree_id DESC) = 1),
tn AS (SELECT doc_name AS doc_id, 'n' || node_ord AS node_id, CASE WHEN parent_ord >= 0 THEN 'n' || parent_ord END AS parent_id, node_ord AS ord, """
    + ", ".join(f"CASE WHEN json_type(node->'$.{c}') NOT IN ('ARRAY', 'OBJECT') THEN node->>'$.{c}' END AS {c}" for c in ("title", "summary", "chunk_id"))
    + ", "
    + ", ".join(f"TRY_CAST(nullif(regexp_extract(CASE WHEN json_type(node->'$.{c}') NOT IN ('ARRAY', 'OBJECT') THEN node->>'$.{c}' END, '([0-9]+)', 1), '') AS INT) AS {c}" for c in ("start_index", "end_index"))
    + """ FROM nodes JOIN lt USING (tree_id)),
pt AS (SELECT *, 1 AS depth, [node_id] AS path FROM tn WHERE parent_id IS NULL UNION ALL SELECT tn.*, pt.depth + 1, list_append(pt.path, tn.node_id) FROM pt JOIN tn ON tn.doc_id = pt.doc_id AND tn.parent_id = pt.node_id),
lo AS (SELECT tn.* FROM tn ANTI JOIN (SELECT doc_id, parent_id AS node_id FROM tn WHERE parent_id IS NOT NULL) USING (doc_id, node_id))"""
)


@query(
    "tr_statistics",
    TREE_SQL
    + """, lv AS (SELECT doc_id, depth, count(*) AS width FROM pt GROUP BY ALL), lc AS (SELECT doc_id, count(*) AS leaves FROM lo GROUP BY doc_id)
SELECT doc_id, sum(width)::BIGINT AS nodes, max(depth) AS max_depth, max(width) AS max_width, """
    + ", ".join(f"round(avg(least({m}, width) / width), 9) AS retained_{m}" for m in (5, 7, 10))
    + ", max(leaves) AS leaves FROM lv LEFT JOIN lc USING (doc_id) GROUP BY doc_id",
)
def tr_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = trees.tree_statistics(tree_nodes(spark, d))
    return out.withColumns({f"retained_{m}": F.round(f"retained_{m}", 9) for m in (5, 7, 10)})


@query(
    "tr_collection",
    TREE_SQL
    + """ SELECT doc_id, node_id AS local_id, doc_id || '_' || node_id AS node_id, coalesce(doc_id || '_' || parent_id, doc_id) AS parent_id, title, 'section' AS node_type, ord + 1 AS ord FROM tn
UNION ALL SELECT DISTINCT doc_id, NULL, doc_id, 'collection', replace(doc_id, '_', ' '), 'document_node', 0 FROM tn UNION ALL SELECT NULL, NULL, 'collection', NULL, 'collection', 'collection_root', 0""",
)
def tr_collection(spark: SparkSession, d: str) -> DataFrame:
    return trees.collection(tree_nodes(spark, d))


@query(
    "tr_descendant_chunks",
    TREE_SQL
    + """, an AS (SELECT doc_id, unnest(path) AS a, node_id FROM pt)
SELECT an.doc_id, an.a AS node_id, string_agg(lo.chunk_id, ',' ORDER BY lo.ord, lo.chunk_id) AS chunks, count(*) AS unseen FROM an JOIN lo USING (doc_id, node_id) WHERE lo.chunk_id IS NOT NULL GROUP BY ALL""",
)
def tr_descendant_chunks(spark: SparkSession, d: str) -> DataFrame:
    return trees.descendant_chunks(materialise(tree_nodes(spark, d))).withColumn("chunks", F.array_join("chunks", ","))


@query(
    "te_sibling_issues",
    TREE_SQL
    + """, g AS (SELECT *, start_index IS NOT NULL AND end_index IS NOT NULL AS good FROM tn),
p AS (SELECT *, last_value(CASE WHEN good THEN start_index END IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN good THEN end_index END IGNORE NULLS) OVER w AS pe FROM g WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, node_id, 'missing_index' AS issue FROM p WHERE NOT good UNION ALL SELECT doc_id, node_id, 'start_after_end' FROM p WHERE good AND start_index > end_index
UNION ALL SELECT doc_id, node_id, 'start_index_goes_backwards' FROM p WHERE good AND start_index < ps UNION ALL SELECT doc_id, node_id, 'start_before_previous_end' FROM p WHERE good AND start_index < pe""",
)
def te_sibling_issues(spark: SparkSession, d: str) -> DataFrame:
    return trees.sibling_issues(tree_nodes(spark, d)).select("doc_id", "node_id", "issue")


# -------------------------------------------------------------------------------------------- retrieval
#: The English stop words as SQL has them, spelled out anew: what is compared shares no constant with the engine.
ENGLISH_SQL = (
    "i me my myself we our ours ourselves you you''re you''ve you''ll you''d your yours yourself yourselves he him his himself she "
    "she''s her hers herself it it''s its itself they them their theirs themselves what which who whom this that that''ll these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don don''t should should''ve now d ll m o re ve y ain aren aren''t couldn couldn''t didn didn''t doesn doesn''t "
    "hadn hadn''t hasn hasn''t haven haven''t isn isn''t ma mightn mightn''t mustn mustn''t needn needn''t shan shan''t shouldn "
    "shouldn''t wasn wasn''t weren weren''t won won''t wouldn wouldn''t "
).strip()
BM25_SQL = rf"""
WITH d AS (SELECT chunk_id AS id, coalesce(text, '') AS t FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS FIRST) = 1) WHERE NOT coalesce(is_duplicate_chunk, false)),
q AS (SELECT DISTINCT query_id, coalesce(query, '') AS t FROM queries),
tok AS (SELECT 'd' AS k, id, t FROM d UNION ALL SELECT 'q', query_id, t FROM q),
ws AS (SELECT k, id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(t), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '' AND NOT list_contains(string_split('{ENGLISH_SQL}', ' '), x)) AS w FROM tok),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM ws WHERE k = 'd'),
p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM ws WHERE k = 'd'), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS r FROM df, st),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT id AS query_id, unnest(w) AS term FROM ws WHERE k = 'q'),
s AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term), st GROUP BY ALL),
hits AS (SELECT q.query_id, d.id, round(coalesce(s.score, 0), 9) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s.score, 0), 9) DESC, d.id) AS rank FROM q CROSS JOIN d LEFT JOIN s ON s.query_id = q.query_id AND s.id = d.id QUALIFY rank <= 5)
"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    chunks = retrieval.canonical(current_chunks(spark, d)).select(F.col("chunk_id").alias("id"), "text")
    return retrieval.bm25(chunks, table(spark, d, "queries").select("query_id", "query").distinct())


@query("rt_bm25", BM25_SQL + "SELECT query_id, rank, id, round(score, 6) AS score FROM hits")
def rt_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


METRICS_SQL = """, ids AS (SELECT query_id, list(id ORDER BY rank) AS ids FROM hits GROUP BY query_id),
g AS (SELECT DISTINCT query_id, bank_name, ground_truth_chunk_id AS gold FROM queries),
m AS (SELECT g.query_id, bank_name, nullif(list_position(ids, gold), 0) AS r FROM g LEFT JOIN ids USING (query_id))
SELECT bank_name, count(DISTINCT query_id) AS queries, avg(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS mean_correct_at_1, avg(CASE WHEN r IS NULL THEN 0 ELSE 1 END) AS mean_hit_at_k, avg(coalesce(1.0 / r, 0)) AS mean_reciprocal_rank FROM m GROUP BY bank_name"""


@query("rt_bm25_eval", BM25_SQL + METRICS_SQL)
def rt_bm25_eval(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, hit rate and mean reciprocal rank of lexical retrieval for each bank."""
    gold = table(spark, d, "queries").select("query_id", "bank_name", F.col("ground_truth_chunk_id").alias("gold")).distinct()
    rows = gold.join(evaluation.ranked_ids(_bm25(spark, d)), "query_id", "left")
    return evaluation.aggregate_metrics(evaluation.retrieval_metrics(rows), ["bank_name"])


@query(
    "rt_doc_scores",
    BM25_SQL + ", c AS (SELECT DISTINCT chunk_id AS id, doc_name AS doc_id FROM chunks) SELECT query_id, doc_id, round(sum(score) / sqrt(count(*) + 1), 6) AS doc_score FROM hits JOIN c USING (id) GROUP BY ALL",
)
def rt_doc_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("doc_name").alias("doc_id")).distinct()
    out = retrieval.document_scores(_bm25(spark, d).join(docs, "id"))
    return out.withColumn("doc_score", F.round("doc_score", 6))


@query(
    "rt_dense",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(q.v, r.v), 9) AS score FROM v q CROSS JOIN v r WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM s QUALIFY rank <= 5""",
)
def rt_dense(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows, itself included, of every row whose id is divisible by 50, exactly."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = retrieval.dense_top_k(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple[str, str, int], DataFrame] = {}


def section_index(spark: SparkSession, d: str) -> DataFrame:
    """The beam's index over the trees of a data folder, written once for each session."""
    held = spark.sparkContext.applicationId, d, cleared()
    if held not in _INDEXES:
        nodes = materialise(tree_nodes(spark, d))
        tops = nodes.groupBy("doc_id").agg(F.first("doc_description").alias("s")).select("doc_id", F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("chunk_id"), text.joined_text(F.translate("doc_id", "_-", "  "), F.col("s")).alias("text"))
        own = nodes.select("doc_id", "node_id", F.coalesce("parent_id", F.lit("root")).alias("parent_id"), "ord", "chunk_id", text.joined_text(F.col("title"), F.col("summary")).alias("text"))
        both = own.unionByName(tops).withColumn("key", F.concat_ws("\x01", "doc_id", "node_id"))
        vectors = providers.hashed_vectors(both, "key", "text", 256)
        _INDEXES[held] = materialise(retrieval.beam_index(both.join(vectors, "key").drop("key", "text")))
    return _INDEXES[held]


def _asked_vectors(spark: SparkSession, d: str) -> DataFrame:
    return materialise(providers.hashed_vectors(table(spark, d, "queries").select("query_id", "query").distinct(), "query_id", "query", 256))


BEAM_SQL = (
    TREE_SQL
    + r""", rt AS (SELECT DISTINCT doc_id FROM tn), ds AS (SELECT doc_name AS doc_id, doc_description FROM lt),
tx AS (SELECT doc_id, node_id, coalesce(parent_id, 'root') AS up, ord, chunk_id, concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(summary), '')) AS t FROM tn
  UNION ALL SELECT doc_id, 'root', NULL, -1, NULL, concat_ws(chr(10), trim(replace(replace(doc_id, '_', ' '), '-', ' ')), nullif(trim(doc_description), '')) FROM rt JOIN ds USING (doc_id)),
wd AS (SELECT doc_id, node_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM tx), nb AS (SELECT doc_id, node_id, ('0x' || left(md5(w), 8))::BIGINT % 256 AS b, count(*)::DOUBLE AS c FROM wd GROUP BY ALL),
nv AS (SELECT doc_id, node_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, node_id)) AS x FROM nb),
qw AS (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[\p{L}\p{N}]+')) AS w FROM (SELECT DISTINCT query_id, query FROM queries)), qb AS (SELECT query_id, ('0x' || left(md5(w), 8))::BIGINT % 256 AS b, count(*)::DOUBLE AS c FROM qw GROUP BY ALL),
qv AS (SELECT query_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS y FROM qb), qi AS (SELECT DISTINCT query_id FROM qv),
rs AS (SELECT query_id, doc_id, round(sum(x * y), 9) AS score FROM nv JOIN qv USING (b) WHERE node_id = 'root' GROUP BY ALL),
bd AS (SELECT query_id, doc_id FROM (SELECT query_id, d.doc_id, coalesce(score, 0) AS score FROM qi CROSS JOIN (SELECT DISTINCT doc_id FROM nv WHERE node_id = 'root') d LEFT JOIN rs USING (query_id, doc_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) = 1),
sc AS (SELECT bd.query_id, tx.doc_id, tx.node_id, tx.up, tx.ord, tx.chunk_id, CASE WHEN tx.node_id IN (SELECT node_id FROM nv n WHERE n.doc_id = tx.doc_id) THEN coalesce(round((SELECT sum(x * y) FROM nv JOIN qv USING (b) WHERE nv.doc_id = tx.doc_id AND nv.node_id = tx.node_id AND qv.query_id = bd.query_id), 9), 0) ELSE -1 END AS score,
  EXISTS (SELECT 1 FROM tx c WHERE c.doc_id = tx.doc_id AND c.up = tx.node_id) AS inner_ FROM bd JOIN tx USING (doc_id)),
fr AS (SELECT query_id, doc_id, node_id, chunk_id, score, inner_, 0 AS level, 1::BIGINT AS place FROM sc WHERE node_id = 'root'
  UNION ALL SELECT query_id, doc_id, node_id, chunk_id, score, inner_, level, place FROM (SELECT s.query_id, s.doc_id, s.node_id, s.chunk_id, s.score, s.inner_, f.level + 1 AS level, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, f.place, s.ord, s.node_id) AS place FROM fr f JOIN sc s ON s.query_id = f.query_id AND s.up = f.node_id WHERE f.inner_) WHERE place <= 10),
cd AS (SELECT * FROM fr WHERE NOT inner_ QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(chunk_id, 'node ' || node_id) ORDER BY score DESC, level, place) = 1),
beam AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level, place)::INT AS rank, node_id, chunk_id, score FROM cd QUALIFY rank <= 5)"""
)


@query("rt_beam", BEAM_SQL + " SELECT query_id, doc_id, rank, node_id, chunk_id, round(score, 6) AS score FROM beam")
def rt_beam(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchical beam over section trees with hashed word vectors."""
    return retrieval.beam_search(section_index(spark, d), _asked_vectors(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "rt_beam_rerank",
    BEAM_SQL
    + r""", cn AS (SELECT query_id, doc_id, node_id, chunk_id, score AS node_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level, place) AS node_rank FROM cd),
cc AS (SELECT chunk_id, concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(heading), ''), nullif(trim(text), '')) AS t FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM cn) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS FIRST) = 1),
cw AS (SELECT chunk_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS w FROM cc), cb AS (SELECT chunk_id, ('0x' || left(md5(w), 8))::BIGINT % 256 AS b, count(*)::DOUBLE AS c FROM cw GROUP BY ALL),
cv AS (SELECT chunk_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS x FROM cb),
cs AS (SELECT cn.query_id, cn.chunk_id, round(sum(x * y), 9) AS s FROM (SELECT DISTINCT query_id, chunk_id FROM cn) cn JOIN cv USING (chunk_id) JOIN qv USING (query_id, b) GROUP BY ALL),
fi AS (SELECT cn.*, CASE WHEN chunk_id IN (SELECT chunk_id FROM cv) THEN coalesce(cs.s, 0) ELSE node_score END AS score, CASE WHEN chunk_id IN (SELECT chunk_id FROM cv) THEN 'chunk' ELSE 'node' END AS scored_by FROM cn LEFT JOIN cs USING (query_id, chunk_id))
SELECT query_id, doc_id, node_id, chunk_id, round(node_score, 6) AS node_score, round(score, 6) AS score, scored_by, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_rank) AS rank FROM fi QUALIFY rank <= 5""",
)
def rt_beam_rerank(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of the beam, ordered anew by the texts of their chunks."""
    asked = _asked_vectors(spark, d)
    chunks = current_chunks(spark, d).select("chunk_id", text.joined_text(F.col("title"), F.col("heading"), F.col("text")).alias("t"))
    found = materialise(retrieval.beam_search(section_index(spark, d), asked, k=None))
    wanted = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    out = retrieval.rerank(found, asked, providers.hashed_vectors(wanted, "chunk_id", "t", 256))
    return out.withColumns({"node_score": F.round("node_score", 6), "score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("rt_walk")
def rt_walk(spark: SparkSession, d: str) -> DataFrame:
    """Step-by-step walk of each question's own document."""
    nodes = tree_nodes(spark, d).withColumn("text", text.joined_text(F.col("title"), F.col("summary")))
    asked = table(spark, d, "queries").select("query_id", F.col("doc_name").alias("doc_id"), "query").distinct()
    out = navigator.walk_trees(asked, nodes.select("doc_id", "node_id", "parent_id", "ord", "chunk_id", "text"))
    return out.withColumn("top5", F.array_join("top5", ","))


@query(
    "rt_beam_eval",
    BEAM_SQL
    + """, ids AS (SELECT query_id, list(chunk_id ORDER BY rank) FILTER (chunk_id IS NOT NULL) AS ids FROM beam GROUP BY query_id), g AS (SELECT DISTINCT query_id, bank_name, ground_truth_chunk_id AS gold FROM queries),
mt AS (SELECT g.query_id, bank_name, nullif(list_position(ids, gold), 0) AS r FROM g LEFT JOIN ids USING (query_id))
SELECT bank_name, count(DISTINCT query_id) AS queries, avg(CASE WHEN r = 1 THEN 1 ELSE 0 END) AS mean_correct_at_1, avg(CASE WHEN r IS NULL THEN 0 ELSE 1 END) AS mean_hit_at_k, avg(coalesce(1.0 / r, 0)) AS mean_reciprocal_rank FROM mt GROUP BY bank_name""",
)
def rt_beam_eval(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, hit rate and mean reciprocal rank of the beam for each bank."""
    gold = table(spark, d, "queries").select("query_id", "bank_name", F.col("ground_truth_chunk_id").alias("gold")).distinct()
    hits = rt_beam(spark, d).where("chunk_id IS NOT NULL").select("query_id", "rank", F.col("chunk_id").alias("id"))
    return evaluation.aggregate_metrics(evaluation.retrieval_metrics(gold.join(evaluation.ranked_ids(hits), "query_id", "left")), ["bank_name"])


@query("ev_agreement")
def ev_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the walk's separate top result and its ranked list agree on the gold chunk, with shares."""
    gold = table(spark, d, "queries").select("query_id", F.col("ground_truth_chunk_id").alias("gold")).distinct()
    rows = gold.join(rt_walk(spark, d).select("query_id", "top1", F.split("top5", ",").alias("ids")), "query_id", "left")
    m = evaluation.retrieval_metrics(rows).withColumn("top1_hit", F.coalesce((F.col("top1") == F.col("gold")).cast("int"), F.lit(0)))
    return evaluation.distribution(m.withColumn("agreement", evaluation.agreement_class(F.col("top1_hit"), F.col("gold_rank"))), [], "agreement")


# ------------------------------------------------------------------------------- joins and ground truth
@query(
    "jn_documents",
    f"""WITH docs AS (SELECT DISTINCT regexp_replace({CLEAN_ID_SQL.format('doc_name')}, '^_+|_+$', '', 'g') AS doc FROM chunks), i AS (SELECT DISTINCT ground_truth_chunk_id AS id FROM queries)
SELECT id, max_by(doc, length(doc)) AS document FROM i LEFT JOIN docs ON id = doc OR starts_with(id, doc || '_') GROUP BY id""",
)
def jn_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "chunks").select(text.clean_doc_id(F.col("doc_name")).alias("doc")).distinct()
    ids = table(spark, d, "queries").select(F.col("ground_truth_chunk_id").alias("id")).distinct()
    return evaluation.document_of(ids, docs, "id", "doc")


@query(
    "jn_queries_chunks",
    f"""WITH {CURRENT_SQL}, q AS (SELECT DISTINCT query_id, ground_truth_chunk_id AS chunk_id, chunk_heading AS heading FROM queries)
SELECT q.query_id, q.chunk_id, coalesce(nullif(q.heading, ''), c.heading) AS heading, c.title FROM q LEFT JOIN cur c ON q.chunk_id = c.chunk_id""",
)
def jn_queries_chunks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").select("query_id", F.col("ground_truth_chunk_id").alias("chunk_id"), F.col("chunk_heading").alias("heading")).distinct()
    return evaluation.join_filled(q, current_chunks(spark, d).select("chunk_id", "heading", "title"), "chunk_id", ["heading"])


@query(
    "jn_contained",
    f"""WITH {EVIDENCE_SQL}, {CURRENT_SQL}, e AS (SELECT evidence_id, doc_name, {MATCH_KEY_SQL.format("coalesce(evidence_text, '')")} AS ek FROM ev), c AS (SELECT chunk_id, doc_name, {MATCH_KEY_SQL.format("coalesce(text, '')")} AS ck FROM cur)
SELECT evidence_id, chunk_id, CASE WHEN contains(ck, ek) THEN 1.0 ELSE length(ck) / length(ek) END AS score FROM e JOIN c USING (doc_name) WHERE ek <> '' AND ck <> '' AND (contains(ck, ek) OR contains(ek, ck))""",
)
def jn_contained(spark: SparkSession, d: str) -> DataFrame:
    """Evidence within chunks of its document, or chunks within it."""
    out = matching.match_scores(*_matching(spark, d))
    return out.where("match_type <> 'partial_line_number_match'").select("evidence_id", "chunk_id", "score")


def _matching(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = current_evidence(spark, d).select("evidence_id", F.col("doc_name").alias("doc"), F.col("evidence_text").alias("text"))
    return e, current_chunks(spark, d).select("chunk_id", F.col("doc_name").alias("doc"), "text")


@query("ev_ground_truth")
def ev_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Copies are left out before evidence is matched; ids are those under which chunks are retrieved."""
    e, _ = _matching(spark, d)
    own = retrieval.canonical(current_chunks(spark, d))
    chunks = own.select(answers.retrieval_id(F.col("retrieval_chunk_id"), F.col("canonical_chunk_id"), F.col("chunk_id")).alias("chunk_id"), F.col("doc_name").alias("doc"), "text")
    best = matching.best_matches(matching.match_scores(e, chunks, every=False))
    questions = current_evidence(spark, d).select("evidence_id", F.col("financebench_id").alias("question"))
    return matching.ground_truth(questions, best)


@query(
    "ev_plan",
    f"""WITH {CURRENT_SQL}, e AS (SELECT chunk_id, row_number() OVER (ORDER BY sha1('42:' || chunk_id), chunk_id) AS r, count(*) OVER () AS n FROM cur WHERE {WORDS_SQL.format('text')} >= 100)
SELECT chunk_id, 1000 // n + CASE WHEN r <= 1000 % n THEN 1 ELSE 0 END AS planned FROM e""",
)
def ev_plan(spark: SparkSession, d: str) -> DataFrame:
    """A thousand questions spread evenly over the chunks of a hundred words or more."""
    rows = materialise(current_chunks(spark, d).where(token_count(F.col("text")) >= 100).select("chunk_id"))
    return evaluation.assign_plan(rows, "chunk_id", 1000).select("chunk_id", F.col("planned").cast("long").alias("planned"))


# ------------------------------------------------------------------------------------------- statistics
@query(
    "ag_lengths",
    f"""WITH {CURRENT_SQL}, l AS (SELECT doc_name, 'chars' AS measure, length(text)::DOUBLE AS x FROM cur WHERE text IS NOT NULL UNION ALL SELECT doc_name, 'words', {WORDS_SQL.format('text')}::DOUBLE FROM cur UNION ALL SELECT doc_name, 'tokens', token_count::DOUBLE FROM cur WHERE token_count > 0)
SELECT CASE WHEN grouping(doc_name) = 1 THEN 'Total' ELSE doc_name END AS doc_name, measure, count(*) AS n, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS max
FROM l GROUP BY GROUPING SETS ((doc_name, measure), (measure))""",
)
def ag_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = current_chunks(spark, d).select("doc_name", F.length("text").alias("chars"), token_count(F.col("text")).alias("words"), F.when(F.col("token_count") > 0, F.col("token_count")).alias("tokens"))
    out = evaluation.length_distribution(rows, "doc_name", ["chars", "words", "tokens"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "median", "q3", "p95")})


RUN_TIME_SQL = "coalesce(" + ", ".join(f"try_strptime(trim(run_timestamp), '{f}')" for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M")) + ")"
RUNS_SQL = f"runs AS (SELECT *, {RUN_TIME_SQL} AS t FROM chunk_runs QUALIFY row_number() OVER (PARTITION BY dataset, doc_name ORDER BY t DESC NULLS FIRST, loaded_at DESC NULLS LAST, run_id DESC) = 1)"


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each document's latest run; of times that can't be read the latest loaded."""
    return evaluation.keep_latest(table(spark, d, "chunk_runs"), ["dataset", "doc_name"], text.run_time(F.col("run_timestamp")), F.col("loaded_at").desc_nulls_last(), F.col("run_id").desc())


@query("wn_latest_runs", f"WITH {RUNS_SQL} SELECT dataset, doc_name, run_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS run_time FROM runs")
def wn_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return latest_runs(spark, d).select("dataset", "doc_name", "run_id", F.date_format(text.run_time(F.col("run_timestamp")), "yyyy-MM-dd HH:mm:ss").alias("run_time"))


@query(
    "ag_runs",
    f"""WITH {RUNS_SQL} SELECT dataset, count(*) AS documents, sum(num_chunks)::BIGINT AS chunks, sum(total_tokens)::BIGINT AS tokens, round(avg(CASE WHEN latency_seconds >= 0 THEN latency_seconds END), 4) AS mean_latency,
round(sum(total_tokens) / nullif(sum(num_chunks), 0), 4) AS tokens_per_chunk, round(avg(total_tokens / nullif(num_chunks, 0)), 4) AS mean_tokens_per_chunk FROM runs GROUP BY dataset""",
)
def ag_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sums, means, and rates both as ratio of sums and as mean of ratios."""
    ok = F.when(F.col("latency_seconds") >= 0, F.col("latency_seconds"))
    return latest_runs(spark, d).groupBy("dataset").agg(F.count("*").alias("documents"), F.sum("num_chunks").alias("chunks"), F.sum("total_tokens").alias("tokens"), F.round(F.avg(ok), 4).alias("mean_latency"), F.round(text.safe_divide(F.sum("total_tokens").cast("double"), F.sum("num_chunks")), 4).alias("tokens_per_chunk"), F.round(F.avg(text.safe_divide(F.col("total_tokens").cast("double"), F.col("num_chunks"))), 4).alias("mean_tokens_per_chunk"))


@query(
    "ag_latency",
    """WITH l AS (SELECT dataset, latency_seconds AS x FROM chunk_runs WHERE latency_seconds >= 0)
SELECT dataset, count(x) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(coalesce(stddev_samp(x), 0), 6) AS std, round(quantile_cont(x, 0.95), 6) AS p95 FROM l GROUP BY dataset""",
)
def ag_latency(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.latency_statistics(table(spark, d, "chunk_runs").where("latency_seconds >= 0"), ["dataset"], "latency_seconds")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "p95")})


@query(
    "ag_stages",
    f"""WITH {RUNS_SQL} SELECT dataset, 'input' AS stage, sum(input_tokens)::BIGINT AS tokens, NULL::BIGINT AS calls FROM runs GROUP BY 1 UNION ALL SELECT dataset, 'output', sum(output_tokens)::BIGINT, NULL FROM runs GROUP BY 1
UNION ALL SELECT dataset, 'calls', NULL, sum(coalesce(llm_successful_calls, 0) + coalesce(llm_failed_calls, 0))::BIGINT FROM runs GROUP BY 1""",
)
def ag_stages(spark: SparkSession, d: str) -> DataFrame:
    """One row for each stage of a data set, with the columns that the stage has."""
    per = latest_runs(spark, d).groupBy("dataset").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum(F.coalesce("llm_successful_calls", F.lit(0)) + F.coalesce("llm_failed_calls", F.lit(0))).alias("c"))
    rows = F.array(F.struct(F.lit("input").alias("stage"), F.col("i").alias("tokens"), F.lit(None).cast("long").alias("calls")), F.struct(F.lit("output").alias("stage"), F.col("o").alias("tokens"), F.lit(None).cast("long").alias("calls")), F.struct(F.lit("calls").alias("stage"), F.lit(None).cast("long").alias("tokens"), F.col("c").alias("calls")))
    return per.select("dataset", F.inline(rows))


@query(
    "ag_match_types",
    f"WITH {EVIDENCE_SQL} SELECT company, match_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY company), 6) AS share FROM ev GROUP BY company, match_type",
)
def ag_match_types(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.distribution(current_evidence(spark, d), ["company"], "match_type")
    return out.withColumn("share", F.round("share", 6))


CATEGORIES = ["evidence_contained_in_chunk", "chunk_contained_in_evidence", "partial_line_number_match", "no_match"]


@query(
    "ag_categories",
    f"WITH {EVIDENCE_SQL} SELECT company, count(*) AS n, " + ", ".join(f"count(*) FILTER (match_type = '{c}') AS n_{c}, round(100 * count(*) FILTER (match_type = '{c}') / count(*), 3) AS pct_{c}" for c in CATEGORIES) + " FROM ev GROUP BY company",
)
def ag_categories(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.category_table(current_evidence(spark, d), ["company"], "match_type", CATEGORIES)


@query(
    "ag_coverage",
    f"WITH {EVIDENCE_SQL} SELECT match_type, count(DISTINCT financebench_id) AS queries, round(count(DISTINCT financebench_id) / (SELECT count(DISTINCT financebench_id) FROM ev), 6) AS coverage FROM ev GROUP BY match_type",
)
def ag_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = current_evidence(spark, d)
    out = evaluation.coverage(e, e, ["match_type"], "financebench_id")
    return out.withColumn("coverage", F.round("coverage", 6))


@query(
    "ag_counters",
    f"WITH {CURRENT_SQL} SELECT bank_name, count(*) AS chunks, count(*) FILTER (generate_queries) AS with_questions, count(DISTINCT doc_name) AS documents, sum(coalesce(num_queries, 0))::BIGINT AS questions FROM cur GROUP BY bank_name",
)
def ag_counters(spark: SparkSession, d: str) -> DataFrame:
    return current_chunks(spark, d).groupBy("bank_name").agg(F.count("*").alias("chunks"), F.count_if("generate_queries").alias("with_questions"), F.countDistinct("doc_name").alias("documents"), F.sum(F.coalesce("num_queries", F.lit(0))).alias("questions"))


@query(
    "so_best_evidence",
    """SELECT financebench_id, evidence_id FROM (SELECT * FROM evidence_report WHERE financebench_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY financebench_id ORDER BY coalesce(kept, false) DESC, matched_at DESC NULLS LAST, evidence_id DESC) = 1""",
)
def so_best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each question a kept evidence before one that isn't, of equals the latest."""
    rows = table(spark, d, "evidence_report").where("financebench_id IS NOT NULL")
    return evaluation.keep_best(rows, ["financebench_id"], F.col("kept"), F.struct("matched_at", "evidence_id")).select("financebench_id", "evidence_id")


@query(
    "so_distinct_terms",
    r"WITH w AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM (SELECT DISTINCT query_id, query FROM queries)) SELECT term, count(DISTINCT query_id) AS queries FROM w GROUP BY term",
)
def so_distinct_terms(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries").select("query_id", "query").distinct()
    return q.select("query_id", F.explode(F.array_distinct(word_array(F.col("query")))).alias("term")).groupBy("term").agg(F.count("*").alias("queries"))


# --------------------------------------------------------------------------------------------- streaming
@query("ev_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ev_windows(spark: SparkSession, d: str) -> DataFrame:
    return results.windowed(table(spark, d, "events"))


@query("st_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream over the event files."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return results.run_to_table(results.windowed(stream))


@query(
    "ev_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ev_sessions(spark: SparkSession, d: str) -> DataFrame:
    return results.sessions(table(spark, d, "events"))
