"""Evidence against the chunks of its document: how well each holds it, which is best, what becomes ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import evidence_lines, held_share, match_key, multiset_coverage, numbers
from leafmill.session import materialise


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring: a window over ``a`` that grows while ``b`` holds it and never shrinks,
    so that ``b`` is searched at most once for each character of ``a``."""
    best = at = 0
    while at + best < len(a):
        while at + best < len(a) and a[at : at + best + 1] in b:
            best += 1
        at += 1
    return best


def _lcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch["ek"].to_pylist(), batch["ck"].to_pylist()
        ratio = [longest_common(x, y) / len(x) if x and y else 0.0 for x, y in zip(a, b)]
        yield pa.record_batch({"evidence_id": batch["evidence_id"], "chunk_id": batch["chunk_id"], "lcs_ratio": pa.array(ratio, pa.float64())})


def match_scores(evidence: DataFrame, chunks: DataFrame, every: bool = True) -> DataFrame:
    """``evidence_id, chunk_id, match_type, score, line_coverage, number_coverage, lcs_ratio`` for every evidence
    (``evidence_id, doc, text``) and chunk (``chunk_id, doc, text``) of one document.

    Contained in the chunk: 1. Chunk within the evidence: share of its length. Otherwise the greater of
    .75 line + .25 number coverage and .65 longest common run + .35 number coverage. Empty evidence matches nothing;
    the longest run is sought only where containment fails. With ``every`` off it isn't sought for evidence that some
    chunk contains whole either (run 0 there): it could no longer lead.
    """
    # keys, lines and numbers once for each row, not once for each pair
    et, ct = F.coalesce("text", F.lit("")), F.coalesce("text", F.lit(""))
    e = materialise(evidence.select("evidence_id", "doc", match_key(et).alias("ek"), evidence_lines(et).alias("lines"), numbers(et).alias("en")).where("ek <> ''"))
    c = materialise(chunks.select("chunk_id", "doc", match_key(ct).alias("ck"), numbers(ct).alias("cn")).where("ck <> ''"))
    pairs = e.join(c, "doc")
    held, holds = F.contains("ck", "ek"), F.contains("ek", "ck")
    whole = pairs.where(held | holds).select("evidence_id", "chunk_id", F.when(held, "evidence_contained_in_chunk").otherwise("chunk_contained_in_evidence").alias("match_type"), F.when(held, 1.0).otherwise(F.length("ck") / F.length("ek")).alias("score"), F.lit(1.0).alias("line_coverage"), F.lit(1.0).alias("number_coverage"), F.when(held, 1.0).otherwise(F.length("ck") / F.length("ek")).alias("lcs_ratio"))
    # the search for common runs is heavy for its bytes: spread it by number of pairs, not by size
    spread = max(evidence.sparkSession.sparkContext.defaultParallelism, int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = pairs.where(~(held | holds)).repartition(spread, "evidence_id", "chunk_id")
    sought = rest if every else rest.join(whole.where("score = 1.0").select("evidence_id").distinct(), "evidence_id", "left_anti").repartition(spread, "evidence_id", "chunk_id")
    run = sought.select("evidence_id", "chunk_id", "ek", "ck").mapInArrow(_lcs, f"evidence_id {evidence.schema['evidence_id'].dataType.simpleString()}, chunk_id string, lcs_ratio double")
    cover = rest.select("evidence_id", "chunk_id", held_share(F.col("lines"), F.col("ck")).alias("line_coverage"), multiset_coverage(F.col("en"), F.col("cn")).alias("number_coverage"))
    score = F.greatest(0.75 * F.col("line_coverage") + 0.25 * F.col("number_coverage"), 0.65 * F.col("lcs_ratio") + 0.35 * F.col("number_coverage"))
    part = cover.join(run, ["evidence_id", "chunk_id"], "left").withColumn("lcs_ratio", F.coalesce("lcs_ratio", F.lit(0.0))).select("evidence_id", "chunk_id", F.lit("partial_line_number_match").alias("match_type"), score.alias("score"), "line_coverage", "number_coverage", "lcs_ratio")
    return whole.unionByName(part)


def best_matches(scores: DataFrame, keep: float = 0.65) -> DataFrame:
    """The best chunk for each evidence, ties by chunk id, and whether its score is enough."""
    first = F.min_by(F.struct("chunk_id", "match_type", "score", "line_coverage", "number_coverage", "lcs_ratio"), F.struct(-F.round("score", 9), "chunk_id"))
    return scores.groupBy("evidence_id").agg(first.alias("b")).select("evidence_id", "b.*").withColumn("kept", F.col("score") >= keep)


def ground_truth(evidence: DataFrame, best: DataFrame) -> DataFrame:
    """``question, evidences, chunk_id, reason``: a question with one evidence, one match and one chunk has that chunk;
    otherwise the first reason that applies."""
    rows = evidence.select("evidence_id", "question").distinct().join(best.select("evidence_id", "chunk_id", "kept"), "evidence_id", "left")
    per = rows.groupBy("question").agg(F.count("*").alias("evidences"), F.count_if(F.coalesce("kept", F.lit(False))).alias("matched"), F.collect_set(F.when(F.col("kept"), F.col("chunk_id"))).alias("ids"))
    reason = F.when(F.col("evidences") != 1, "evidence_count_not_one").when(F.col("matched") == 0, "no_match").when(F.size("ids") != 1, "chunk_count_not_one").otherwise("kept")
    return per.select("question", "evidences", F.when(reason == "kept", F.get("ids", 0)).alias("chunk_id"), reason.alias("reason"))
