"""The pN_ queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import encoding, leaks, mixing, neardup, scans, spans, splitting
from leafmill.plans.queries import Registry
from leafmill.session import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("LEAFMILL_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = os.path.join(TOKENIZERS, "byte_bpe_50k.json")

REGISTRY = Registry()
query = REGISTRY.query



# ------------------------------------------------------------------ 1: noise in text from scanned pages
@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found_debris(table(spark, d, "chunks")).toDF("chunk_id", "field", "kind")


@query("p1_repaired")
def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its text and start phrase as continuous paragraphs."""
    out = scans.repair_pages(table(spark, d, "chunks"), "chunk_id", "doc_name", ["text", "start_phrase"])
    return out.select(F.col("key").alias("chunk_id"), "field", F.array_join("kinds", ",").alias("kinds"), "text").distinct()


# --------------------------------------------------------------- 2: near-duplicate records with small edits
P2 = {"shingle": 4, "threshold": 0.6, "min_words": 30}

P2_PAIRS_SQL = r"""
WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM chunks),
g AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) AS gs FROM w WHERE len(ws) >= 30),
e AS (SELECT chunk_id, len(gs) AS n, unnest(gs) AS s FROM g),
p AS (SELECT x.chunk_id AS a, y.chunk_id AS b, x.n AS na, y.n AS nb, count(*) AS k
      FROM e x JOIN e y ON x.s = y.s AND x.chunk_id < y.chunk_id GROUP BY ALL),
pairs AS (SELECT a AS chunk_id_a, b AS chunk_id_b FROM p WHERE k >= 0.6 * (na + nb - k))
"""


@query("p2_found", P2_PAIRS_SQL + "SELECT * FROM pairs")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "chunks"), **P2).toDF("chunk_id_a", "chunk_id_b")


@query(
    "p2_groups",
    P2_PAIRS_SQL.replace("WITH w", "WITH RECURSIVE w")
    + """, links AS (SELECT chunk_id_a AS a, chunk_id_b AS b FROM pairs UNION SELECT chunk_id_b, chunk_id_a FROM pairs),
reach AS (SELECT DISTINCT chunk_id AS a, chunk_id AS b FROM chunks UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT a AS chunk_id, min(b) AS group_id, count(*) AS group_size FROM reach GROUP BY a""",
)
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    out = neardup.near_duplicate_groups(table(spark, d, "chunks"), **P2)
    return out.select(F.col("id").alias("chunk_id"), "group_id", "group_size")


# ------------------------------------------------------------- 3: long exact spans shared between records
@query(
    "p3_found",
    """
WITH e AS (SELECT DISTINCT evidence_id, evidence_text AS t FROM evidence_report WHERE length(evidence_text) >= 150),
g AS (SELECT DISTINCT evidence_id, unnest(list_transform(range(1, length(t) - 148), lambda i: substr(t, i, 150))) AS s FROM e)
SELECT DISTINCT x.evidence_id AS evidence_id_a, y.evidence_id AS evidence_id_b FROM g x JOIN g y ON x.s = y.s AND x.evidence_id < y.evidence_id""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "evidence_report"), "evidence_id", "evidence_text").toDF("evidence_id_a", "evidence_id_b")


@query(
    "p3_shared",
    """
WITH u AS (SELECT evidence_id, evidence_text AS t FROM evidence_report QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY length(coalesce(evidence_text, '')) DESC, md5(coalesce(evidence_text, '')) DESC) = 1),
e AS (SELECT DISTINCT evidence_id, evidence_text AS t FROM evidence_report WHERE length(evidence_text) >= 150),
g AS (SELECT evidence_id, t, unnest(range(0, length(t) - 149)) AS i FROM e), w AS (SELECT evidence_id, t, i, substr(t, i + 1, 150) AS s FROM g),
c AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT evidence_id) > 1),
h AS (SELECT DISTINCT w.evidence_id, i AS a, i + 150 AS b FROM w JOIN c USING (s) JOIN u ON u.evidence_id = w.evidence_id AND u.t = w.t),
n AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY evidence_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY evidence_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM n), m AS (SELECT evidence_id, k, min(a) AS a, max(b) AS b FROM k GROUP BY ALL),
o AS (SELECT evidence_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans, sum(b - a)::INT AS shared_chars FROM m GROUP BY evidence_id),
l AS (SELECT evidence_id, lcs_ratio, line_coverage FROM evidence_report QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY matched_at DESC NULLS LAST, lcs_ratio DESC NULLS LAST, line_coverage DESC NULLS LAST) = 1)
SELECT u.evidence_id, length(coalesce(u.t, ''))::INT AS chars, coalesce(spans, '') AS spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(u.t) > 0 THEN coalesce(shared_chars, 0) / length(u.t) ELSE 0.0 END AS shared, lcs_ratio, line_coverage FROM u LEFT JOIN o USING (evidence_id) LEFT JOIN l USING (evidence_id)""",
)
def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    """Each evidence with its recurring spans, beside the stored scores of its latest delivery."""
    rows = table(spark, d, "evidence_report")
    out = spans.shared_share(rows, "evidence_id", "evidence_text")
    stored = rows.groupBy(F.col("evidence_id").alias("id")).agg(F.max_by(F.struct("lcs_ratio", "line_coverage"), F.struct("matched_at", "lcs_ratio", "line_coverage")).alias("s"))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.join(stored, "id", "left").select(F.col("id").alias("evidence_id"), "chars", shown.alias("spans"), "shared_chars", "shared", "s.lcs_ratio", "s.line_coverage")


@query(
    "p3_classes",
    """
WITH e AS (SELECT DISTINCT evidence_id, evidence_text AS t FROM evidence_report WHERE length(evidence_text) >= 150), c AS (SELECT t, min(evidence_id) AS class_id, count(*) AS copies FROM e GROUP BY t)
SELECT evidence_id, class_id, copies FROM e JOIN c USING (t) QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY class_id, copies) = 1""",
)
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which evidence stands for each one among exact copies."""
    return spans.text_classes(table(spark, d, "evidence_report"), "evidence_id", "evidence_text").withColumnRenamed("id", "evidence_id")


# ------------------------------------------------ 4: splitting oversized items at natural boundaries
@query(
    "p4_found",
    r"""
WITH w AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 800),
m AS (SELECT chunk_id,
  list_max(list_transform(regexp_split_to_array(text, '\r?\n[ \t]*(?:\r?\n[ \t]*)+'), lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')))) AS p,
  list_max(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')))) AS l FROM w)
SELECT chunk_id, CASE WHEN p <= 800 THEN 'paragraph' WHEN l <= 800 THEN 'line' ELSE 'word' END AS boundary FROM m""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = splitting.split_oversized(table(spark, d, "chunks"))
    return out.where("piece = 0").select(F.col("id").alias("chunk_id"), "boundary")


@query(
    "p4_pieces",
    r"""
WITH w AS (SELECT DISTINCT chunk_id, text, regexp_extract_all(text, '[^ \t\r\n]+[ \t\r\n]*') AS k FROM chunks WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > 800),
b AS (SELECT *, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\r?\n[ \t]*(?:\r?\n[ \t]*)+'), lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')))) <= 800 THEN 'paragraph'
  WHEN list_max(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: len(regexp_extract_all(x, '[^ \t\r\n]+')))) <= 800 THEN 'line' ELSE 'word' END AS boundary FROM w),
s AS (SELECT *, array_to_string(list_transform(k, lambda t, i: CASE WHEN i = len(k) THEN 'e' WHEN regexp_matches(t, '\n[ \t]*\r?\n') THEN 'p' WHEN regexp_matches(t, '\n') THEN 'l' WHEN regexp_matches(t, '[.!?:;][ \t\r\n]+$') THEN 's' ELSE 'w' END), '') AS letters FROM b),
c AS (SELECT *, list_transform(regexp_extract_all(letters, '[plsw]{0,719}[pe]|[plsw]{359,719}l|[plsw]{359,719}s|[plsw]{0,719}[plsw]'), lambda x: len(x)) AS n FROM s),
p AS (SELECT chunk_id, boundary, k, n, len(n) AS pieces, unnest(range(1, len(n) + 1)) AS i FROM c),
o AS (SELECT *, list_sum(n[1:i - 1]) AS before FROM p),
t AS (SELECT *, rtrim(array_to_string(k[coalesce(before, 0) + 1:coalesce(before, 0) + n[i]], ''), ' ' || chr(9) || chr(10) || chr(13)) AS body,
  CASE WHEN i > 1 THEN array_to_string(list_transform(k[greatest(before - n[i - 1], before - 80) + 1:before], lambda x: rtrim(x, ' ' || chr(9) || chr(10) || chr(13))), ' ') END AS lead FROM o)
SELECT chunk_id, boundary, CAST(i - 1 AS INT) AS piece, CAST(pieces AS INT) AS pieces, CAST(n[i] + CASE WHEN i > 1 THEN least(80, n[i - 1]) ELSE 0 END AS INT) AS word_count,
  CAST(CASE WHEN i > 1 THEN least(80, n[i - 1]) ELSE 0 END AS INT) AS overlap_words, concat_ws(' ', lead, body) AS text FROM t""",
)
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks")).withColumnRenamed("id", "chunk_id")


# ------------------------------------------------- 6: evaluation texts leaking into training text
@query(
    "p6_found",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS s FROM d WHERE len(w) >= 12),
i12 AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS s FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM ds JOIN i12 USING (s)""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_tile=12)
    return out.where("longest >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query("p6_leaks")
def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks by tiles of five words: items covered by 0.8 or more however reordered, or with a run of 12 words."""
    out = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_tile=5)
    return out.where("coverage >= 0.8 OR longest >= 12").withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


# ------------------------------------------------------------ 7: mixing sources to target weights
@query(
    "p7_found",
    r"""
WITH d AS (SELECT nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n FROM documents),
s AS (SELECT source, sum(n) AS n FROM d WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, target_share, max_repeats FROM mix_targets)
SELECT t.source FROM t LEFT JOIN s USING (source) WHERE coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(n) FROM s)""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_plan(table(spark, d, "documents"), table(spark, d, "mix_targets")).where("NOT reachable").select("source")


@query(
    "p7_plan",
    r"""
WITH d AS (SELECT nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n FROM documents),
s AS (SELECT source, sum(n) AS n FROM d WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, target_share, max_repeats FROM mix_targets)
SELECT t.source, CAST(coalesce(s.n, 0) AS BIGINT) AS size, CAST(coalesce(s.n, 0) * max_repeats AS BIGINT) AS capacity, target_share * (SELECT sum(n) FROM s) AS wanted,
  coalesce(s.n, 0) * max_repeats >= target_share * (SELECT sum(n) FROM s) AS reachable FROM t LEFT JOIN s USING (source)""",
)
def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, capacities and wanted sizes in words."""
    return mixing.mixture_plan(table(spark, d, "documents"), table(spark, d, "mix_targets")).select("source", "size", "capacity", "wanted", "reachable")


@query("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares really reached, sizes in tokens of a public tokenizer."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)[1]


@query("p7_mixture")
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: one row for each use of a document."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)[0].withColumnRenamed("id", "doc_id")


# ---------------------------------------------------- 8: garbled text from wrong character encoding
@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents")).select(F.col("doc").alias("doc_id"))


@query("p8_restored")
def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restore(table(spark, d, "documents")).withColumnRenamed("doc", "doc_id")
