"""Queries that write a table in one of the engine's formats into the shared folder and read it back, and the workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.functions.words import word_array
from leafmill.plans.core_queries import CLEAN_ID_SQL, CURRENT_SQL, EVIDENCE_SQL, current_chunks, current_evidence
from leafmill.plans.queries import Registry
from leafmill.session import scratch, table
from leafmill.sources import io
from leafmill.sources.workspace import Workspace

REGISTRY = Registry()
query = REGISTRY.query


@query("io_jsonl", f"WITH {CURRENT_SQL} SELECT chunk_id, title, start_index, is_duplicate_chunk FROM cur")
def io_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read under a declared schema."""
    path = scratch(spark, "jsonl")
    io.write_jsonl(current_chunks(spark, d), path)
    return io.read_jsonl(spark, path, "chunk_id string, title string, start_index int, is_duplicate_chunk boolean")


@query("io_lenient", f"WITH {CURRENT_SQL} SELECT chunk_id, token_count FROM cur WHERE token_count IS NULL OR token_count % 3 <> 0")
def io_lenient(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which every line with a size that three divides is cut off; these are left out."""
    path = scratch(spark, "lines")
    line = F.to_json(F.struct("chunk_id", "token_count"))
    cut = F.coalesce(F.col("token_count") % 3 == 0, F.lit(False))
    current_chunks(spark, d).select(F.when(cut, F.left(line, F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    return io.read_jsonl(spark, path, "chunk_id string, token_count int", strict=False)


@query("io_runs", "SELECT run_id::VARCHAR AS run_id, coalesce(try_cast(num_chunks AS DOUBLE), 0) AS num_chunks, coalesce(try_cast(latency_seconds AS DOUBLE), 0) AS latency_seconds FROM chunk_runs")
def io_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run table written as CSV and read back; unreadable numbers are 0."""
    path = scratch(spark, "runs")
    table(spark, d, "chunk_runs").select("run_id", "run_timestamp", "num_chunks", "latency_seconds").write.option("header", True).csv(path)
    return io.read_runs(spark, path, ["num_chunks", "latency_seconds"]).select("run_id", "num_chunks", "latency_seconds")


@query("io_append", f"WITH {CURRENT_SQL} SELECT chunk_id, CASE WHEN doc_name < 'M' THEN 1 ELSE 2 END AS run FROM cur")
def io_append(spark: SparkSession, d: str) -> DataFrame:
    """A table that a second run completes: what the first has written stays as it is."""
    path, schema = scratch(spark, "append"), "chunk_id string, run int"
    rows = current_chunks(spark, d).select("chunk_id", "doc_name")
    io.append_new(rows.where("doc_name < 'M'").select("chunk_id", F.lit(1).alias("run")), path, "chunk_id", schema)
    io.append_new(rows.select("chunk_id", F.lit(2).alias("run")), path, "chunk_id", schema)
    return spark.read.schema(schema).json(path)


@query("io_issues", "SELECT 'No issues found.' AS message")
def io_issues(spark: SparkSession, d: str) -> DataFrame:
    """An empty table of issues as CSV."""
    path = scratch(spark, "issues")
    io.write_issues(current_chunks(spark, d).select(F.col("chunk_id").alias("message")).where("false"), path)
    return spark.read.option("header", True).csv(path)


@query(
    "io_results",
    r"""WITH f AS (SELECT DISTINCT doc_name || CASE WHEN num_chunks % 3 = 0 THEN '_clean.jsonl' ELSE '.jsonl' END AS file FROM chunk_runs), b AS (SELECT file, regexp_replace(file, '(?:_clean)?\.jsonl$', '') AS b FROM f)
SELECT file FROM b QUALIFY row_number() OVER (PARTITION BY b ORDER BY ends_with(file, '_clean.jsonl') DESC, file DESC) = 1""",
)
def io_results(spark: SparkSession, d: str) -> DataFrame:
    """Of result files of one name the clean one."""
    runs = table(spark, d, "chunk_runs")
    return io.chosen_results(runs.select(F.concat("doc_name", F.when(F.col("num_chunks") % 3 == 0, "_clean.jsonl").otherwise(".jsonl")).alias("file")).distinct())


@query(
    "io_pairs",
    f"""WITH s AS (SELECT DISTINCT doc_name FROM trees), c AS (SELECT DISTINCT doc_name FROM chunks), x AS (SELECT doc_name || '_structure.json' AS file, regexp_replace({CLEAN_ID_SQL.format("doc_name || '_structure.json'")}, '^_+|_+$', '', 'g') AS base FROM s), y AS (SELECT doc_name || '_chunks.jsonl' AS file, regexp_replace({CLEAN_ID_SQL.format("doc_name || '_chunks.jsonl'")}, '^_+|_+$', '', 'g') AS base FROM c)
SELECT x.base, x.file AS structure_file, y.file AS chunk_file FROM x JOIN y USING (base)""",
)
def io_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Structure and chunk files of one document."""
    files = lambda name, end: table(spark, d, name).select(F.concat("doc_name", F.lit(end)).alias("file")).distinct()
    return io.paired(files("trees", "_structure.json"), files("chunks", "_chunks.jsonl"))


@query(
    "io_evidence",
    f"WITH {EVIDENCE_SQL} SELECT evidence_id, evidence_text AS text FROM ev WHERE evidence_text IS NOT NULL AND NOT regexp_matches(evidence_text, '^\\s*\\{{')",
)
def io_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence given as text or as an object that holds it."""
    rows = current_evidence(spark, d).where("evidence_text IS NOT NULL").where(~F.col("evidence_text").rlike(r"^\s*\{"))
    raw = F.when(F.col("evidence_id") % 2 == 0, F.to_json(F.struct(F.col("evidence_text").alias("page_content")))).otherwise(F.col("evidence_text"))
    return rows.select("evidence_id", io.evidence_text(raw).alias("text"))


@query(
    "ws_documents",
    f"WITH {CURRENT_SQL} SELECT doc_name AS doc_id, 'pdf' AS type, replace(doc_name, '_', ' ') AS doc_name, count(*)::INT AS page_count FROM cur GROUP BY ALL",
)
def ws_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document indexed in a workspace, by its metadata."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_name").orderBy("chunk_id")
    pages = current_chunks(spark, d).select(F.col("doc_name").alias("doc_id"), F.row_number().over(w).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    ws = Workspace(spark, scratch(spark, "workspace"))
    ws.index_pages(pages)
    return ws.search("type = 'pdf'").select("doc_id", "type", "doc_name", "page_count")


@query(
    "sc_multisets",
    rf"""WITH {EVIDENCE_SQL}, n AS (SELECT evidence_id, list_transform(regexp_extract_all(coalesce(evidence_text, ''), '\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?'), lambda x: regexp_replace(x, '[$,]', '', 'g')) AS a, list_transform(regexp_extract_all(coalesce(answer, ''), '\(?-?\$?\d[\d,]*(?:\.\d+)?%?\)?'), lambda x: regexp_replace(x, '[$,]', '', 'g')) AS b FROM ev)
SELECT evidence_id, round(CASE WHEN len(b) = 0 THEN 1.0 ELSE list_sum(list_transform(list_distinct(b), lambda x: least(len(list_filter(b, lambda y: y = x)), len(list_filter(a, lambda y: y = x))))) / len(b) END, 9) AS coverage FROM n""",
)
def sc_multisets(spark: SparkSession, d: str) -> DataFrame:
    """Share of an answer's numbers, with repeats, that its evidence holds."""
    e = current_evidence(spark, d)
    return e.select("evidence_id", F.round(text.multiset_coverage(text.numbers(F.col("answer")), text.numbers(F.col("evidence_text"))), 9).alias("coverage"))


@query("sc_words", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS distinct_words FROM documents WHERE text IS NOT NULL")
def sc_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", word_array(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))
