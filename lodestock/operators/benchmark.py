"""Relevance benchmark: a hit if a relevant key is among the first five distinct results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLD = 0.75


def first_distinct(results: DataFrame, k: int = 5) -> DataFrame:
    """The first k results of each query, then each key once at its first place. results: (query_id, doc, place)."""
    return results.where(F.col("place") <= k).groupBy("query_id", "doc").agg(F.min("place").alias("place"))


def hits(items: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, expected_status, label_status, returned, is_hit). items: (query_id, relevant array, expected_status, label_status)."""
    found = first_distinct(results, k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc"))).alias("r"))
    j = items.join(found, "query_id", "left")
    got = F.coalesce(F.transform("r", lambda x: x["doc"]), F.array().cast(items.schema["relevant"].dataType))
    return j.select("query_id", "expected_status", "label_status", got.alias("returned"), F.arrays_overlap(got, "relevant").alias("is_hit"))


def hit_rate(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: queries, hits, hit_rate, enforced (all labels confirmed), passed."""
    asked = F.col("expected_status") == "has_match"
    a = judged.agg(F.count_if(asked).alias("queries"), F.count_if(asked & F.col("is_hit")).alias("hits"), F.coalesce(F.bool_and(F.col("label_status") == "confirmed"), F.lit(False)).alias("enforced"))
    rate = F.when(F.col("queries") > 0, F.round(F.col("hits") / F.col("queries"), 6))
    return a.select("queries", "hits", rate.alias("hit_rate"), "enforced", (~F.col("enforced") | F.coalesce(rate >= threshold, F.lit(False))).alias("passed"))


def ranked_places(results: DataFrame) -> DataFrame:
    """Places from 1 for results (query_id, doc, score)."""
    return results.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc")))
