"""Retrieval metrics, result selection and the statistics reported over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_ids(hits: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, ids``: ids in rank order."""
    return hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


def gold_rank(ids: Column, gold: Column, k: int = 5) -> Column:
    """Place of the gold id among the first k, null if absent."""
    return F.nullif(F.array_position(F.slice(ids, 1, k), gold), F.lit(0)).cast("int")


def retrieval_metrics(results: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``gold_rank, correct_at_1, hit_at_k, reciprocal_rank`` to rows with ``ids`` and ``gold``; a null gold id
    or list counts as a miss."""
    r = gold_rank(F.coalesce("ids", F.array().cast("array<string>")), F.col("gold"), k)
    out = results.withColumn("gold_rank", r)
    return out.withColumns({"correct_at_1": F.coalesce((F.col("gold_rank") == 1).cast("int"), F.lit(0)), "hit_at_k": F.col("gold_rank").isNotNull().cast("int"), "reciprocal_rank": F.coalesce(1 / F.col("gold_rank"), F.lit(0.0))})


def agreement_class(top1_hit: Column, rank: Column) -> Column:
    """How a separately chosen top result and the ranked list agree on the gold id."""
    return (
        F.when((top1_hit == 1) & (rank == 1), "both first").when((top1_hit == 1) & rank.isNotNull(), "top right, list lower").when(top1_hit == 1, "top right, not in list")
        .when(rank == 1, "list first, top wrong").when(rank.isNotNull(), "in list, top wrong").otherwise("neither")
    )


def aggregate_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct queries and means of the metrics for each group; null keys form a group."""
    return rows.groupBy(*keys).agg(F.countDistinct("query_id").alias("queries"), *(F.avg(c).alias(f"mean_{c}") for c in ("correct_at_1", "hit_at_k", "reciprocal_rank")))


# ---------------------------------------------------------------- fixed values
#: What tells configurations apart.
CONFIG = ["dataset", "result_file", "method", "model", "variant", "top_m"]
#: (mean, of which column), in the order of the report.
MEANS = [
    ("accuracy_at_1", "correct_at_1"), ("hit_at_5", "hit_at_5"), ("mrr_at_5", "reciprocal_rank_at_5"), ("document_accuracy_at_1", "document_correct_at_1"),
    ("avg_latency_seconds", "latency_seconds"), ("avg_top1_latency_seconds", "top1_latency_seconds"), ("avg_top5_latency_seconds", "top5_latency_seconds"),
    ("avg_input_tokens", "input_tokens"), ("avg_output_tokens", "output_tokens"), ("avg_total_tokens", "total_tokens"),
    ("avg_top1_input_tokens", "top1_input_tokens"), ("avg_top1_output_tokens", "top1_output_tokens"), ("avg_top1_total_tokens", "top1_total_tokens"),
    ("avg_top5_input_tokens", "top5_input_tokens"), ("avg_top5_output_tokens", "top5_output_tokens"), ("avg_top5_total_tokens", "top5_total_tokens"),
]
PERCENTAGES = ["accuracy_at_1", "hit_at_5", "mrr_at_5", "document_accuracy_at_1"]
# -----------------------------------------------------------------------------


def config_aggregate(rows: DataFrame, keys: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """Distinct queries, the sixteen means, successful rows and the shares as percentages, for each configuration (and
    ``extra`` columns). Null keys form groups; nulls don't count in means; a column that is missing has a null mean."""
    keys = [*(CONFIG if keys is None else keys), *(extra or [])]
    of = lambda c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
    success = F.sum(F.col("run_success").cast("int")) if "run_success" in rows.columns else F.lit(None).cast("long")
    out = rows.groupBy(*keys).agg(F.countDistinct("query_id").alias("n_queries"), *(F.avg(of(c)).alias(name) for name, c in MEANS), success.alias("successful_rows"))
    return out.withColumns({f"{c}_pct": F.col(c) * 100.0 for c in PERCENTAGES})


def document_correct(rows: DataFrame, documents: DataFrame, doc_column: str = "doc_name") -> DataFrame:
    """Adds ``retrieved_doc`` and ``document_correct_at_1`` to results (``top1_doc, top1_chunk_id, doc_name``): the
    document stored with the top result, else the longest known one (``documents``) whose name begins its chunk's id."""
    found = document_of(rows, documents, "top1_chunk_id", doc_column)
    out = found.withColumn("retrieved_doc", F.coalesce(F.nullif("top1_doc", F.lit("")), "document")).drop("document")
    return out.withColumn("document_correct_at_1", F.coalesce((F.col("retrieved_doc") == F.col("doc_name")).cast("int"), F.lit(0)))


def page_totals(documents: DataFrame, keys: list[str], pages: str = "page_count") -> DataFrame:
    """Documents whose pages could be counted, those whose couldn't (null), pages in all and on average."""
    return documents.groupBy(*keys).agg(F.count("*").alias("documents"), F.count(pages).alias("counted"), F.count_if(F.col(pages).isNull()).alias("failed"), F.coalesce(F.sum(pages), F.lit(0)).cast("long").alias("pages"), F.avg(pages).alias("mean_pages"))


def funnel(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """How many chunks each step of question planning leaves: all, not marked as copies, eligible (selected, or left out for
    no other reason than not being selected), selected, and the questions planned for these."""
    selected = F.coalesce("generate_queries", F.lit(False))
    own = ~F.coalesce("is_duplicate_chunk", F.lit(False))
    open_ = selected | F.coalesce("skip_query_reason", F.lit("")).isin("", "not_selected")
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.count_if(own).alias("own"), F.count_if(own & open_).alias("eligible"), F.count_if(selected).alias("selected"), F.coalesce(F.sum(F.when(selected, F.coalesce("num_queries", F.lit(0)))), F.lit(0)).alias("questions"))


def join_named(left: DataFrame, right: DataFrame, on: dict[str, str], suffix: str = "_right") -> DataFrame:
    """Left join on columns of different names (left name: right name); columns of the right that the left has, too, get the
    suffix, and its key columns go."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in on.values()), *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in on.values()))
    condition = None
    for a, b in on.items():
        e = left[a] == other[f"_{b}"]
        condition = e if condition is None else condition & e
    return left.join(other, condition, "left").drop(*(f"_{b}" for b in on.values()))


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by ``order``, with their places from 0: a prefix that doesn't depend on the partitions. Each
    partition sends on its own first n."""
    first = rows.orderBy(order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(order)).cast("long") - 1)


def preview(issues: DataFrame, n: int = 10, *order: str) -> DataFrame:
    """The first n issues in a fixed order, for a report."""
    return issues.orderBy(*(order or issues.columns)).limit(n)


def latency_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one row) and 95th percentile, exact and interpolated; a
    group of nulls only has null statistics."""
    x = F.col(value)
    n = F.count(x)
    return rows.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.when(n > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias("std"), F.percentile(x, F.lit(0.95)).alias("p95"))


def length_distribution(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Long form: statistics of each value for each group and, as group ``Total``, for all rows."""
    long = rows.select(by, F.explode(F.create_map(*[y for v in values for y in (F.lit(v), F.col(v).cast("double"))])).alias("measure", "x")).where("x IS NOT NULL")
    q = F.percentile("x", F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.95))))
    out = long.cube(by, "measure").agg(F.grouping(by).alias("whole"), F.grouping("measure").alias("mixed"), F.count("*").alias("n"), F.avg("x").alias("mean"), q.alias("q"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).where("mixed = 0")
    name = F.when(F.col("whole") == 1, F.lit("Total")).otherwise(F.col(by))
    return out.select(name.alias(by), "measure", "n", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.col("q")[3].alias("p95"), "max")


def keep_latest(rows: DataFrame, keys: list[str], time: Column, *ties: Column) -> DataFrame:
    """The latest row of each key; a time that can't be read counts as latest."""
    w = Window.partitionBy(*keys).orderBy(time.desc_nulls_first(), *ties)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_best(rows: DataFrame, keys: list[str], success: Column, order: Column) -> DataFrame:
    """A successful row beats a failed one; of equals the later stands. Null keys form one group."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(success, F.lit(False)).desc(), order.desc_nulls_last())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def common_queries(rows: DataFrame, config: str, query: str = "query_id") -> DataFrame:
    """Rows of the queries that every configuration has."""
    n = rows.select(config).distinct().count()
    common = rows.groupBy(query).agg(F.countDistinct(config).alias("_n")).where(F.col("_n") == n).select(query)
    return rows.join(common, query, "left_semi")


def coverage(rows: DataFrame, master: DataFrame, keys: list[str], query: str = "query_id") -> DataFrame:
    """Distinct queries of each group, and their share of the master's; null if the master is empty."""
    total = master.agg(F.countDistinct(query)).first()[0]
    return rows.groupBy(*keys).agg(F.countDistinct(query).alias("queries")).withColumn("coverage", F.try_divide(F.col("queries").cast("double"), F.lit(total)))


def distribution(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts of a label and their share of the group."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("share", F.col("n") / whole)


def category_table(rows: DataFrame, keys: list[str], label: str, categories: list[str]) -> DataFrame:
    """One row for each group with the count and percentage of every category, absent ones at 0."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == c).alias(f"n_{c}") for c in categories))
    return out.withColumns({f"pct_{c}": F.round(100 * F.col(f"n_{c}") / F.col("n"), 3) for c in categories})


def join_filled(left: DataFrame, right: DataFrame, on: str, fill: list[str]) -> DataFrame:
    """Left join in which the columns both sides have are filled from the right where null or empty on the left."""
    other = right.select(on, *(F.col(c).alias(f"_{c}") for c in fill), *(c for c in right.columns if c not in left.columns))
    out = left.join(other, on, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) for c in fill}).drop(*(f"_{c}" for c in fill))


def join_on_nullable(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys in which null meets null."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in keys), *(c for c in right.columns if c not in keys))
    on = None
    for c in keys:
        e = left[c].eqNullSafe(other[f"_{c}"])
        on = e if on is None else on & e
    return left.join(other, on, "left").drop(*(f"_{c}" for c in keys))


def document_of(ids: DataFrame, documents: DataFrame, id_column: str, doc_column: str) -> DataFrame:
    """Adds ``document``: the longest document id ``d`` for which the id is ``d`` or starts with ``d_``.

    Every prefix of an id that ends before an underscore is joined by equality, so that neither side is compared
    with all of the other.
    """
    parts = F.split(F.col(id_column), "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    distinct = ids.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    asked = distinct.select(id_column, F.explode(prefixes).alias("_p"))
    docs = documents.select(F.col(doc_column).alias("_p")).distinct()
    best = asked.join(docs, "_p").groupBy(id_column).agg(F.max_by("_p", F.length("_p")).alias("document"))
    return ids.join(best, id_column, "left")


def assign_plan(rows: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """Adds ``planned``: ``target`` spread over the rows as evenly as whole numbers allow; the rows that get one more
    are the first in an order seeded by a hash of the key."""
    n = rows.count()
    if not n:
        return rows.withColumn("planned", F.lit(0))
    first = rows.select(key, F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key))).alias("_h")).orderBy("_h", key).limit(target % n).select(key, F.lit(1).alias("_more"))
    return rows.join(first, key, "left").withColumn("planned", F.lit(target // n) + F.coalesce("_more", F.lit(0))).drop("_more")
