"""Questions from chunks and answers from retrieved chunks: requests, replies, answers and their judgement, each resumable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import providers
from leafmill.functions.text import context_text, first_nonempty, match_key

# ---------------------------------------------------------------- fixed values
#: What an answer says, letter case and outer blanks aside, if the context doesn't hold it.
NO_ANSWER = "Insufficient information to answer the question."
# -----------------------------------------------------------------------------


def retrieval_id(retrieval: Column, canonical: Column, own: Column) -> Column:
    """The id under which a chunk is retrieved: its retrieval id, else its canonical one, else its own."""
    return first_nonempty(retrieval, canonical, own)


def question_requests(chunks: DataFrame) -> DataFrame:
    """``custom_id, chunk_id, source_chunk_id, doc_name, bank_name, title, heading, text, num_queries, prompt`` for chunks
    that are to get questions (``generate_queries`` and a positive ``num_queries``; nulls count as no).

    ``custom_id`` is made from the chunk's own id, so that a request is named alike in every run.
    """
    wanted = chunks.where(F.coalesce("generate_queries", F.lit(False)) & (F.coalesce("num_queries", F.lit(0)) > 0))
    blank = lambda c: F.coalesce(c, F.lit(""))
    doc = first_nonempty("doc_name", "bank_name", F.lit("unknown"))
    rows = wanted.select(
        F.concat(F.lit("row-"), "chunk_id").alias("custom_id"), retrieval_id(F.col("retrieval_chunk_id"), F.col("canonical_chunk_id"), F.col("chunk_id")).alias("chunk_id"), F.col("chunk_id").alias("source_chunk_id"),
        doc.alias("doc_name"), first_nonempty("bank_name", "doc_name", F.lit("unknown")).alias("bank_name"), blank("title").alias("title"), blank("heading").alias("heading"), blank("text").alias("text"), "num_queries",
    )
    parts = [F.lit("Source: "), "bank_name", F.lit("\nChunk: "), "chunk_id", F.lit("\nTitle: "), "title", F.lit("\nHeading: "), "heading", F.lit("\nQuestions wanted: "), F.col("num_queries").cast("string"), F.lit("\n\n"), "text"]
    return rows.withColumn("prompt", F.concat(*parts))


REPLY = "questions array<struct<question:string,answer:string>>"


def questions_of(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """One row for each question of each reply (``custom_id, content, input_tokens, output_tokens, total_tokens``), named
    ``<chunk>_q<i>`` from 1, with what its request says. Replies that aren't such JSON, and replies to no request, have
    no rows; missing questions and answers are empty, missing sizes 0."""
    parsed = replies.select("custom_id", F.from_json("content", REPLY).alias("c"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")))
    each = parsed.select("custom_id", "input_tokens", "output_tokens", "total_tokens", F.posexplode("c.questions").alias("i", "q"))
    out = each.join(requests.drop("prompt"), "custom_id")
    return out.select(
        F.concat("chunk_id", F.lit("_q"), (F.col("i") + 1).cast("string")).alias("query_id"), "doc_name", "bank_name", F.coalesce("q.question", F.lit("")).alias("query"), F.coalesce("q.answer", F.lit("")).alias("answer"),
        F.col("chunk_id").alias("ground_truth_chunk_id"), "source_chunk_id", F.col("title").alias("chunk_title"), F.col("heading").alias("chunk_heading"), F.col("text").alias("chunk"),
        F.col("input_tokens").alias("query_generation_input_tokens"), F.col("output_tokens").alias("query_generation_output_tokens"), F.col("total_tokens").alias("query_generation_total_tokens"),
    )


def answer_requests(results: DataFrame, top_k: int, most_chars: int | None = None) -> DataFrame:
    """``answer_id, query_id, query, context`` of results (``query_id, config, query, top1_chunks, top5_chunks`` as arrays of
    texts). One chunk comes from the separate choice of one and several from the list: the two may differ."""
    if top_k not in (1, 5):
        raise ValueError("top_k: 1 or 5")
    chunks = F.slice(F.coalesce(F.col(f"top{top_k}_chunks"), F.array().cast("array<string>")), 1, top_k)
    key = F.concat_ws("__", "config", "query_id", F.lit(f"top{top_k}"))
    return results.select(key.alias("answer_id"), "query_id", "config", "query", context_text(chunks, most_chars).alias("context"))


def _finished(done: DataFrame | None, key: str) -> DataFrame | None:
    return None if done is None else done.where(F.coalesce("error", F.lit("")) == "").select(key).distinct()


def generated_answers(requests: DataFrame, provider: providers.Provider | None = None, done: DataFrame | None = None) -> DataFrame:
    """``answer_id, generated_answer, failed_calls, error`` of requests without a finished answer in ``done``; without any
    context the answer is that there isn't enough information, and no call is made."""
    old = _finished(done, "answer_id")
    rows = requests if old is None else requests.join(old, "answer_id", "left_anti")
    rows = rows.select("answer_id", F.when(F.col("context") != "", F.concat(F.lit("answer:"), F.coalesce("query", F.lit("")), F.lit("\n\n"), "context")).alias("prompt"))
    out = providers.complete(rows.withColumnRenamed("answer_id", "request_id"), provider)
    return out.select(F.col("request_id").alias("answer_id"), F.coalesce("answer", F.lit(NO_ANSWER)).alias("generated_answer"), "failed_calls", "error")


def judged(answers: DataFrame, provider: providers.Provider | None = None, done: DataFrame | None = None) -> DataFrame:
    """``answer_id, category, failed_calls, error`` of answers (``answer_id, query, expected, generated_answer``) not judged
    yet. Answers without question, expected or given answer aren't judged; one that says that information is missing is
    ``no_answer``. The offline rule, without a provider: ``correct`` if one answer's key holds the other's."""
    old = _finished(done, "answer_id")
    rows = answers if old is None else answers.join(old, "answer_id", "left_anti")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rows = rows.where(filled("query") & filled("expected") & filled("generated_answer"))
    none = F.lower(F.trim("generated_answer")) == NO_ANSWER.lower()
    if provider is None:
        a, b = match_key(F.col("expected")), match_key(F.col("generated_answer"))
        same = (a == b) | (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(a, b) | F.contains(b, a))
        return rows.select("answer_id", F.when(none, "no_answer").when(same, "correct").otherwise("incorrect").alias("category"), F.lit(0).alias("failed_calls"), F.lit(None).cast("string").alias("error"))
    asked = rows.select(F.col("answer_id").alias("request_id"), F.when(~none, F.concat(F.lit("judge:"), "query", F.lit("\n"), "expected", F.lit("\n"), "generated_answer")).alias("prompt"))
    out = providers.complete(asked, provider)
    return out.select(F.col("request_id").alias("answer_id"), F.coalesce(F.nullif("answer", F.lit("")), F.when(F.col("error").isNull(), "no_answer")).alias("category"), "failed_calls", "error")
