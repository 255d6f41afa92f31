"""Mixing sources to target weights, by Sainte-Laguë apportionment.

Blocks of equal size go to sources one by one, each to the source with the highest quotient
``target / (2 * blocks + 1)`` that its repeats still allow (the last block of an exhausted source may be a part of
one); the blocks of a source are apportioned in the same way to groups of its shards, then to the shards of each
group. In each shard the quota takes whole passes over the records, and a seeded order of them fills the rest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafmill.functions.words import token_count
from leafmill.session import materialise

#: Greatest number of tokens in a block; few records together are apportioned in smaller ones.
BLOCK = 1000


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2 s + 1), none above its cap; ties go to the earlier weight.

    A divisor gives all but a few seats at once, so that the work doesn't grow with the seats.
    """
    caps = [seats] * len(weights) if caps is None else caps
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("weights: none may be negative")
    caps = [c if w > 0 else 0 for c, w in zip(caps, exact)]
    seats = min(seats, sum(caps))
    low, high = Fraction(0), Fraction(1)

    def at(m: Fraction) -> list[int]:  # seats whose quotient is above 1 / (2 m)
        return [min(c, math.ceil(w * m - Fraction(1, 2)) if w * m > Fraction(1, 2) else 0) for w, c in zip(exact, caps)]

    while sum(at(high)) < seats:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if sum(at(middle)) <= seats:
            low = middle
        else:
            high = middle
        if sum(at(low)) == seats or sum(at(high)) - sum(at(low)) <= len(weights):
            break
    got = at(low)
    heap = [(-w / (2 * s + 1), i) for i, (w, s, c) in enumerate(zip(exact, got, caps)) if s < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-exact[i] / (2 * got[i] + 1), i))
    return got


def source_name(c: Column) -> Column:
    """Without outer blanks and lower-cased; empty counts as none."""
    name = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(name != "", name)


def sized(docs: DataFrame, doc: str, source: str, text: str, tokenizer: str | None) -> DataFrame:
    """``id, source, size``: records with a source; size in tokens of the tokenizer file (read by the driver and sent
    with the job), or in words (runs of characters between spaces, tabs and line breaks) where none is named."""
    rows = docs.select(F.col(doc).alias("id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).where("source IS NOT NULL")
    if tokenizer is None:
        return rows.select("id", "source", token_count(F.col("text")).cast("long").alias("size"))
    kind = rows.schema["id"].dataType
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.value)
        t.encode_special_tokens = True
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            sizes = [len(e.ids) for i in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pa.record_batch({"id": batch["id"], "source": batch["source"], "size": pa.array(sizes, pa.int64())})

    schema = T.StructType([T.StructField("id", kind), T.StructField("source", T.StringType()), T.StructField("size", T.LongType())])
    return rows.mapInArrow(count, schema)


def block_size(total: int, targets: list[tuple[str, float, int]]) -> int:
    """Tokens of a block: ``BLOCK``, or less where the smallest target would otherwise be under a hundred blocks."""
    least = min((w for _, w, _ in targets if w > 0), default=0.0)
    return max(1, min(BLOCK, int(least * total / 100)))


def apportion(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]], block: int | None = None, total: int | None = None) -> list[dict]:
    """The plan: for each target its size, capacity (size times repeats), wanted size, whether it can be
    reached, its blocks and its quota, which is all its blocks or all its capacity.

    Sources that get no fewer seats with their caps than without, a margin of one seat for each source aside, are
    within reach; of the others the exact sizes decide.
    """
    held = dict(sizes)
    whole = sum(held.values()) if total is None else total
    block = block_size(whole, targets) if block is None else block
    plan = [{"source": s, "target_share": w, "max_repeats": r, "size": held.get(s, 0), "capacity": held.get(s, 0) * r, "wanted": w * whole} for s, w, r in targets]
    weights, seats, caps = [x["target_share"] for x in plan], -(-whole // block), [-(-x["capacity"] // block) for x in plan]
    free, blocks = sainte_lague(weights, seats), sainte_lague(weights, seats, caps)
    for x, n, f, cap in zip(plan, blocks, free, caps):
        short = cap <= f + len(plan)
        x["reachable"], x["blocks"], x["quota"] = not short or x["capacity"] >= x["wanted"], n, min(n * block, x["capacity"])
    return plan


PLAN = "source string, target_share double, max_repeats int, size long, capacity long, wanted double, reachable boolean, blocks long, quota long"


def _targets(targets: DataFrame, most: int) -> list[tuple[str, float, int]]:
    """Targets by source name; sources named twice have their shares added and the fewer repeats."""
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.min(F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1)))).alias("r")).orderBy("source").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"mixing: more than {most} sources with a target")
    return [(r["source"], r["w"], r["r"]) for r in rows]


def _planned(rows: DataFrame, wanted: list[tuple[str, float, int]], block: int | None, total: int | None) -> list[dict]:
    """The plan for records (``source, size``), by one pass over them: of sources without a target only the sum is kept."""
    names = rows.sparkSession.createDataFrame([(s, s) for s, _, _ in wanted], "source string, target string")
    per = rows.groupBy("source").agg(F.sum("size").alias("size")).join(F.broadcast(names), "source", "left").groupBy("target").agg(F.sum("size").alias("size")).collect()
    whole = total if total is not None else sum(r["size"] for r in per)
    return apportion([(r["target"], r["size"]) for r in per if r["target"] is not None], wanted, block, whole)


def _plan_table(spark, plan: list[dict]) -> DataFrame:
    keys = [f.split(" ")[0] for f in PLAN.split(", ")]
    return spark.createDataFrame([tuple(x[k] for k in keys) for x in plan], PLAN)


def mixture_plan(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str | None = None, block: int | None = None, total: int | None = None, most_sources: int = 100_000) -> DataFrame:
    """One row for each source with a target: ``source, target_share, max_repeats, size, capacity, wanted,
    reachable, blocks, quota``.

    ``wanted`` is the target's share of ``total`` (by default the size of all records with a source, those
    without a target included); ``reachable`` says whether all repeats of the source hold it. Records without a
    source don't count; a source without records has size 0. Only the targets' own rows come to the driver.
    """
    wanted = _targets(targets, most_sources)
    return _plan_table(docs.sparkSession, _planned(sized(docs, doc, source, text, tokenizer), wanted, block, total))


def _seats(weights: list[int], quota: int, most: list[int], block: int) -> list[int]:
    """Tokens of a quota for each part, by blocks of the parts' sizes, none above ``most``; what a part's last block
    leaves over goes round again in blocks of half the size."""
    got, left = [0] * len(weights), min(quota, sum(most))
    while left > 0:
        room = [m - g for m, g in zip(most, got)]
        more = sainte_lague(weights, -(-left // block), [-(-r // block) for r in room])
        for i in sorted(range(len(got)), key=lambda i: (-more[i], i)):
            step = min(more[i] * block, room[i], left)
            got[i], left = got[i] + step, left - step
        block = max(1, block // 2)
    return got


def shard_quotas(per: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """``source, shard, size, quota`` from ``source, part, shard, size``: the quota of each source (``source,
    max_repeats, quota``) goes to its parts, then the quota of each part to its shards. A task holds the parts of one
    source, or the shards of one part, at once: about the square root of the shards."""

    def split(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, repeats, quota, held in zip(*(batch[c].to_pylist() for c in ("source", "max_repeats", "quota", "held"))):
                    held = sorted(held, key=lambda p: p["k"])
                    got = _seats([p["size"] for p in held], quota, [p["size"] * repeats for p in held], block)
                    cols = [source] * len(held), [repeats] * len(held), [p["k"] for p in held], [p["size"] for p in held], got
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["source", "max_repeats", key, "size", "quota"])

        return run

    of = lambda k: F.collect_list(F.struct(F.col(k).alias("k"), "size")).alias("held")
    parts = per.groupBy("source", "part").agg(F.sum("size").alias("size")).groupBy("source").agg(of("part")).join(F.broadcast(plan), "source").select("source", "max_repeats", "quota", "held")
    parts = parts.mapInArrow(split("part"), "source string, max_repeats int, part long, size long, quota long")
    shards = per.groupBy("source", "part").agg(of("shard")).join(parts.drop("size"), ["source", "part"]).select("source", "max_repeats", "quota", "held")
    return shards.mapInArrow(split("shard"), "source string, max_repeats int, shard long, size long, quota long").where("quota > 0")


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str | None = None, block: int | None = None, total: int | None = None, seed: int = 42, shard_size: int = 20_000_000, most_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The mixture, and its report.

    Mixture: ``id, source, copy, size``: one row for each use of a record; each is used ``max_repeats`` times at
    most, a second time only after every record of its shard once. The record at a quota's end is taken if more
    than half of it fits, so that shards miss their quotas on both sides alike. Report: the plan with ``used`` and
    ``share``, the share of the mixture's size really reached. Records of size 0 aren't used.
    """
    spark = docs.sparkSession
    rows = materialise(sized(docs, doc, source, text, tokenizer))
    wanted = _targets(targets, most_sources)
    plan = _planned(rows, wanted, block, total)
    size = sum(x["size"] for x in plan)
    whole = total if total is not None else size
    block = block_size(whole, wanted) if block is None else block
    table = _plan_table(spark, plan)
    shards = max(1, -(-size // shard_size))
    groups = max(1, math.isqrt(shards))
    mine = rows.where("size > 0").join(F.broadcast(table.where("quota > 0").select("source")), "source", "left_semi").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)))
    per = mine.groupBy("source", "shard").agg(F.sum("size").alias("size")).withColumn("part", F.pmod("shard", F.lit(groups)))
    quota = shard_quotas(per, table.select("source", "max_repeats", "quota"), block).select("source", "shard", F.expr("quota div size").alias("passes"), (F.col("quota") % F.col("size")).alias("rest"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", F.lit(seed)), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = mine.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quota, ["source", "shard"])
    uses = placed.withColumn("n", F.col("passes") + (2 * F.col("before") + F.col("size") < 2 * F.col("rest")).cast("int")).where("n > 0")
    chosen = materialise(uses.select("id", "source", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"), "size"))
    used = chosen.groupBy("source").agg(F.sum("size").alias("used"), F.count("*").alias("uses"))
    every = chosen.agg(F.sum("size")).first()[0] or 0
    report = table.join(used, "source", "left").select(*table.columns, F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("uses", F.lit(0)).alias("uses"), (F.coalesce("used", F.lit(0)) / F.lit(max(1, every))).alias("share"))
    return chosen, report
