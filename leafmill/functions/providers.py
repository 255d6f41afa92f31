"""Model calls behind one small interface, with deterministic rule-based defaults.

A provider answers a batch of requests; calls, failures and sizes come out as columns beside the answers.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QuotaExceeded(RuntimeError):
    """No more calls are possible; retrying is useless."""


class RateLimited(RuntimeError):
    """Too many calls just now."""


class Provider(Protocol):
    def complete(self, prompt: str) -> str: ...


class RuleProvider:
    """Answers by rules: ``summary:`` with the first sentence, ``yes_no:`` by a pattern, anything else with its text."""

    def complete(self, prompt: str) -> str:
        task, _, body = prompt.partition(":")
        if task == "summary":
            return re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0]
        if task == "yes_no":
            pattern, _, text = body.partition("\x00")
            return json.dumps({"answer": "yes" if re.search(pattern, text) else "no"})
        return body.strip()


def with_retries(call: Callable[[str], str], prompt: str, retries: int = 10, wait: float = 0.0, empty_is_error: bool = False) -> tuple[str, int, str | None]:
    """Answer ("" on failure), number of failed calls, error. Quota errors stop at once, rate limits after the last
    retry with an exception; other errors leave an empty answer."""
    error: Exception | None = None
    for i in range(retries):
        try:
            out = call(prompt)
            if out or not empty_is_error:
                return out, i, None
            error = ValueError("empty answer")
        except QuotaExceeded:
            raise
        except Exception as e:  # noqa: BLE001
            error = e
        if wait and i + 1 < retries:
            time.sleep(wait * 2**i)
    if isinstance(error, RateLimited):
        raise error
    return "", retries, str(error)


def complete(requests: DataFrame, provider: Provider | None = None, retries: int = 10, wait: float = 0.0) -> DataFrame:
    """``request_id, answer, failed_calls, input_tokens, output_tokens, error`` for ``request_id, prompt`` rows; a null
    prompt has a null answer and no call."""
    provider = provider or RuleProvider()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, 0, None) if p is None else with_retries(provider.complete, p, retries, wait) for p in batch["prompt"].to_pylist()]
            size = [len((x or "").split()) for x in batch["prompt"].to_pylist()]
            yield pa.record_batch({"request_id": batch["request_id"].cast(pa.string()), "answer": pa.array([r[0] for r in rows], pa.string()), "failed_calls": pa.array([r[1] for r in rows], pa.int32()), "input_tokens": pa.array(size, pa.int32()), "output_tokens": pa.array([len((r[0] or "").split()) for r in rows], pa.int32()), "error": pa.array([r[2] for r in rows], pa.string())})

    return requests.select("request_id", "prompt").mapInArrow(run, "request_id string, answer string, failed_calls int, input_tokens int, output_tokens int, error string")


def complete_until(call: Callable[[list[str]], tuple[str, bool]], most: int = 6) -> str:
    """Goes on asking, with everything said so far, until the answer is finished; raises after ``most`` calls."""
    said: list[str] = []
    for _ in range(most):
        part, finished = call(list(said))
        said.append(part)
        if finished:
            return "".join(said)
    raise RuntimeError(f"unfinished after {most} calls")


def answer_of(reply: str | None, key: str, default: str = "no") -> str:
    """A field of a JSON reply; the default for empty, malformed and other replies."""
    body = re.sub(r"^```(?:json)?|```$", "", (reply or "").strip()).strip()
    try:
        return str(json.loads(body)[key])
    except (ValueError, KeyError, TypeError):
        return default


def summaries(nodes: DataFrame, provider: Provider | None = None, short: int = 200) -> DataFrame:
    """Adds ``summary``: a text of up to ``short`` tokens is its own; longer ones are summarised."""
    text = F.coalesce("text", F.lit(""))
    small = F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")) <= short
    asked = complete(nodes.where(~small).select(F.concat_ws("\x01", "doc_id", "node_id").alias("request_id"), F.concat(F.lit("summary:"), text).alias("prompt")), provider)
    both = nodes.withColumn("request_id", F.concat_ws("\x01", "doc_id", "node_id")).join(asked.select("request_id", F.col("answer").alias("_a")), "request_id", "left")
    return both.withColumn("summary", F.when(small, text).otherwise(F.col("_a"))).drop("request_id", "_a")


def hashed_vector(tokens: Column, dimensions: int = 64) -> Column:
    """Bag of hashed words at length 1, in the JVM; null without tokens. Word w counts at md5(w) mod dimensions."""
    at = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    places = F.transform(tokens, at)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(places, lambda p: p == d)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: x / norm))


def hashed_vectors(rows: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """``key, vector``: the same vectors in Arrow batches, for large tables; null for texts without words."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.functions.memo import Memo
        from leafmill.functions.words import words

        place = Memo(lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions, 500_000)
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                at = [place[w] for w in words(t)]
                v = np.bincount(at, minlength=dimensions).astype(float) if at else None
                out.append(None if v is None else (v / np.sqrt((v * v).sum())).tolist())
            yield pa.record_batch({"key": batch["key"], "vector": pa.array(out, pa.list_(pa.float64()))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def parent_summaries(nodes: DataFrame, provider: Provider | None = None, most_depth: int = 64) -> DataFrame:
    """``doc_id, node_id, summary`` of a whole tree (``doc_id, node_id, parent_id, ord, summary``, the leaves' summaries
    given): a parent's is made from its children's, in order, level by level from below. Existing ones stay."""
    from leafmill.operators.trees import with_paths
    from leafmill.session import materialise

    rows = materialise(with_paths(nodes).select("doc_id", "node_id", "parent_id", "ord", "depth", "summary"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    if deepest > most_depth:
        raise RuntimeError(f"trees deeper than {most_depth} levels")
    done = rows.where(F.col("depth") == deepest)
    out = done
    for depth in range(deepest - 1, 0, -1):
        below = done.where("parent_id IS NOT NULL AND summary IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"]), "\n").alias("_b"))
        level = rows.where(F.col("depth") == depth).join(below, ["doc_id", "node_id"], "left").withColumn("request_id", F.concat_ws("\x01", "doc_id", "node_id"))
        asked = complete(level.where("summary IS NULL AND _b IS NOT NULL").select("request_id", F.concat(F.lit("summary:"), "_b").alias("prompt")), provider)
        done = materialise(level.join(asked.select("request_id", "answer"), "request_id", "left").select("doc_id", "node_id", "parent_id", "ord", "depth", F.coalesce("summary", "answer").alias("summary")))
        out = out.unionByName(done)
    return out.select("doc_id", "node_id", "summary")


def missing_vectors(rows: DataFrame, cache: DataFrame, key: str, model: str) -> DataFrame:
    """Rows without a vector of the model in the cache (``key, model, vector``)."""
    return rows.join(cache.where(F.col("model") == model).select(key), key, "left_anti")


def encoded(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """``key, vector`` by an encoder that takes a list of texts; texts without content have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part["text"].to_pylist()
            out: list = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t and t.strip()]
            for i in range(0, len(asked), batch):
                own = asked[i : i + batch]
                for j, v in zip(own, encode([texts[j] for j in own])):
                    out[j] = [float(x) for x in v]
            yield pa.record_batch({"key": part["key"], "vector": pa.array(out, pa.list_(pa.float64()))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def cached_vectors(rows: DataFrame, key: str, text: str, path: str, model: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``key, vector`` of all rows, those known from the table at ``path`` not encoded again; new ones are added to it.

    Vectors are kept by the hash of the text, so that a changed text is encoded anew. At the end every distinct text must
    have one row for the model in the table, or this raises.
    """
    spark = rows.sparkSession
    hashed = rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_id"), F.coalesce(text, F.lit("")).alias("t"))
    schema = "text_id string, model string, vector array<double>"
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path_)
    known = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    new = missing_vectors(hashed.dropDuplicates(["text_id"]), known, "text_id", model)
    encoded(new, "text_id", "t", encode).withColumn("model", F.lit(model)).select("text_id", "model", "vector").write.mode("append").parquet(path)
    held = spark.read.schema(schema).parquet(path).where(F.col("model") == model)
    wanted = hashed.select("text_id").distinct()
    n, have = wanted.count(), wanted.join(held, "text_id").count()
    if n != have:
        raise RuntimeError(f"vectors at {path}: {have} rows for {n} texts")
    return hashed.select(key, "text_id").join(held.select("text_id", "vector"), "text_id").drop("text_id")
