"""The best rows of each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_k(df: DataFrame, query: str, score: Column, k: int, *ties: Column) -> DataFrame:
    """``rank`` from 1 and the k best rows of each query, ties by the given order."""
    w = Window.partitionBy(query).orderBy(score.desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
