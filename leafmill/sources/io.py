"""Readers and writers of the engine's artefacts: JSON lines, tree files, CSV tables, pages, logs, result folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import clean_doc_id, run_time

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines under a declared schema, blank lines skipped. A malformed line raises, or, not strict, is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, structure``: one whole file to a row; its base name is the document's."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("structure"))
    return rows.select(clean_doc_id(F.col("file")).alias("doc_name"), "structure")


def read_runs(spark: SparkSession, path: str, numbers: list[str], time: str = "run_timestamp") -> DataFrame:
    """A run table in CSV: unreadable numbers are 0, unreadable times null (column ``run_time``)."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in numbers}).withColumn("run_time", run_time(F.col(time)))


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``doc_id, page, text``. Without ``extract``: text files with pages divided by form feeds. With it: binary files,
    each given to ``extract`` (a parser of the caller's) in the executors."""
    if extract is None:
        whole = spark.read.option("wholetext", True).text(path).select(clean_doc_id(F.col("_metadata.file_name")).alias("doc_id"), F.posexplode(F.split("value", "\f")).alias("i", "text"))
        return whole.select("doc_id", (F.col("i") + 1).alias("page"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["content"].to_pylist()):
                pages = extract(body)
                yield pa.record_batch({"doc_id": pa.array([doc] * len(pages), pa.string()), "page": pa.array(range(1, len(pages) + 1), pa.int32()), "text": pa.array(pages, pa.string())})

    files = spark.read.format("binaryFile").load(path)
    return files.select(clean_doc_id(F.regexp_extract("path", r"([^/]+)$", 1)).alias("doc_id"), "content").mapInArrow(run, "doc_id string, page int, text string")


def paired(structures: DataFrame, chunks: DataFrame, name: str = "file") -> DataFrame:
    """Structure and chunk files of one base name; those without a partner are left out."""
    a = structures.withColumn("base", clean_doc_id(F.col(name)))
    b = chunks.withColumn("base", clean_doc_id(F.col(name)))
    return a.select("base", F.col(name).alias("structure_file")).join(b.select("base", F.col(name).alias("chunk_file")), "base")


def chosen_results(files: DataFrame, name: str = "file") -> DataFrame:
    """Of result files: the clean one beats the raw one of its name, files with an explicit ``_top_m_`` beat the generic
    one of their family."""
    base = F.regexp_replace(F.col(name), r"(?:_clean)?\.jsonl$", "")
    rows = files.select(F.col(name), base.alias("_b"), F.col(name).rlike(r"_clean\.jsonl$").alias("_clean"))
    best = rows.groupBy("_b").agg(F.max_by(name, F.struct(F.col("_clean"), F.col(name))).alias(name))
    best = best.withColumns({"_family": F.regexp_replace("_b", r"_top_m_\d+", ""), "_explicit": F.col("_b").rlike(r"_top_m_\d+")})
    wide = best.where("_explicit").select("_family").distinct()
    return best.where("_explicit").unionByName(best.where("NOT _explicit").join(wide, "_family", "left_anti")).select(name)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_issues(issues: DataFrame, path: str) -> None:
    """Issues as CSV; a table without any holds one row that says so."""
    if issues.isEmpty():
        issues = issues.sparkSession.createDataFrame([("No issues found.",)], "message string")
    issues.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str, schema: str | T.StructType) -> int:
    """Appends rows whose key isn't in the JSON lines table yet, in one commit; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(schema).json(path).select(key).distinct()
        fresh = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    fresh = fresh.dropDuplicates([key])
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n


def latest_log(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, pages, tokens, toc_present`` from the newest log of each document; later entries overwrite earlier."""
    lines = spark.read.text(path).select(clean_doc_id(F.regexp_replace(F.col("_metadata.file_name"), r"(?:_\d{8}_\d{6})?\.(?:log|json)$", "")).alias("doc_name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    newest = lines.groupBy("doc_name").agg(F.max_by("file", F.struct("at", "file")).alias("file"))
    got = lambda k: F.nullif(F.regexp_extract("value", rf'"?{k}"?\s*[:=]\s*"?([\w.-]+)', 1), F.lit(""))
    last = lambda k: F.max_by(got(k), F.when(got(k).isNotNull(), F.col("n"))).alias(k)
    rows = lines.join(newest, ["doc_name", "file"]).groupBy("doc_name").agg(last("total_page_number"), last("total_token"), last("toc_present"))
    return rows.select("doc_name", F.col("total_page_number").cast("int").alias("pages"), F.col("total_token").cast("long").alias("tokens"), "toc_present")


def evidence_text(raw: Column) -> Column:
    """Text of an evidence that is a plain string or an object with a text under one of the usual names."""
    keys = ("evidence_text", "text", "page_content", "chunk_text", "content")
    got = F.coalesce(*(F.get_json_object(raw, f"$.{k}") for k in keys))
    return F.when(raw.rlike(r"^\s*\{"), got).otherwise(raw)
