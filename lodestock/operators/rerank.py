"""Re-ranking: graded judgments, verdicts that mark or drop, and undoing them; recommendation assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import probability

RELATED, UNRELATED = "related", "unrelated"


def soft_rerank(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Hits (query_id, doc, rank) by level (high first), then by their old rank. Every hit needs exactly one judgment (query_id, doc, level), and no other has one."""
    one = judgments.groupBy("query_id", "doc").agg(F.count("*").alias("n"), F.first("level").alias("level"))
    j = hits.withColumn("__hit", F.lit(1)).join(one, ["query_id", "doc"], "full_outer")
    bad = F.col("__hit").isNull() | F.col("n").isNull() | (F.col("n") > 1)
    level = F.when(bad, F.raise_error(F.concat(F.lit("judgments must match hits: "), F.col("doc").cast("string"))).cast("int")).otherwise(F.col("level").cast("int"))
    w = W.partitionBy("query_id").orderBy(F.desc("level"), "original_rank")
    return j.withColumn("level", level).withColumnRenamed("rank", "original_rank").withColumn("rank", F.row_number().over(w)).drop("n", "__hit")


def bounded_levels(results: DataFrame, allowed: DataFrame, limit: int = 40) -> DataFrame:
    """A model's answers held to what was asked: known pairs, the first of each, levels 1 to 3, at most `limit` a role. results: (role_id, main_sku, level, place)."""
    kept = results.where(F.col("level").between(1, 3)).join(allowed.select("role_id", "main_sku").distinct(), ["role_id", "main_sku"], "left_semi")
    first = kept.withColumn("__n", F.row_number().over(W.partitionBy("role_id", "main_sku").orderBy("place"))).where("__n = 1").drop("__n")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("role_id").orderBy(F.desc("level"), "place"))).where(F.col("rank") <= limit)


def confidently_unrelated(verdict: Column, score: Column, cutoff: float) -> Column:
    return F.coalesce((verdict == UNRELATED) & (probability(score) >= cutoff), F.lit(False))


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, *, cutoff: float, drop: bool, by: tuple[str, ...] = ("scene", "role")) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped). kept: rank by verdict (related, unanswered, unrelated), stock (in, unknown, out), recall; recall_rank keeps the old rank.

    candidates: scene, role, main_sku, rank, country_available; verdicts: (scene, main_sku, verdict, probability).
    """
    asked = verdicts.select("scene", "main_sku", F.col("verdict").alias("rerank"), F.col("probability").alias("__p")).dropDuplicates(["scene", "main_sku"])
    j = candidates.withColumnRenamed("rank", "recall_rank").join(asked, ["scene", "main_sku"], "left")
    gone = confidently_unrelated(F.col("rerank"), F.col("__p"), cutoff) if drop else F.lit(False)
    group = F.when(F.col("rerank") == RELATED, 0).when(F.col("rerank") == UNRELATED, 2).otherwise(1)
    stock = F.when(F.col("country_available"), 0).when(~F.col("country_available"), 2).otherwise(1)
    w = W.partitionBy(*by).orderBy(group, stock, "recall_rank")
    kept = j.where(~gone).drop("__p").withColumn("rank", F.row_number().over(w))
    return kept, j.where(gone).drop("__p").withColumn("rank", F.col("recall_rank"))


def strip_verdicts(kept: DataFrame, dropped: DataFrame, by: tuple[str, ...] = ("scene", "role")) -> DataFrame:
    """The recall list again: dropped rows back in, order by recall_rank, labels gone. Doing it twice changes nothing."""
    both = kept.unionByName(dropped, allowMissingColumns=True)
    place = F.coalesce(F.nullif(F.col("recall_rank"), F.lit(0)), "rank", F.lit(0)) if "recall_rank" in both.columns else F.coalesce("rank", F.lit(0))
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(place))).drop("recall_rank", "rerank")


def questions(candidates: DataFrame) -> DataFrame:
    """(scene, main_sku, ...): each SKU of a scene once, as its first role and rank have it."""
    w = W.partitionBy("scene", "main_sku").orderBy("role_place", "rank")
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def question_batches(asked: DataFrame, size: int = 300) -> DataFrame:
    """`asked` plus batch, from 0, in slices of `size` a scene."""
    w = W.partitionBy("scene").orderBy("role_place", "rank", "main_sku")
    return asked.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def read_answers(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Verdicts of batches that answered soundly: a batch naming a foreign or a repeated SKU is refused whole; unanswered SKUs stay silent.

    answers: (scene, batch, main_sku, verdict, probability); asked: (scene, batch, main_sku).
    """
    known = asked.select("scene", "batch", "main_sku", F.lit(True).alias("known"))
    j = answers.join(known, ["scene", "batch", "main_sku"], "left")
    repeated = j.groupBy("scene", "batch", "main_sku").agg(F.count("*").alias("n"), F.max("known").alias("known")).where("n > 1 or known is null").select("scene", "batch").distinct()
    fine = j.join(repeated, ["scene", "batch"], "left_anti").where(F.col("verdict").isin(RELATED, UNRELATED))
    return fine.select("scene", "main_sku", "verdict", probability(F.col("probability")).alias("probability"))


def verdict_summary(asked: DataFrame, verdicts: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row: asked, answered, related, unrelated, dropped."""
    a = asked.select("scene", "main_sku").distinct().join(verdicts.select("scene", "main_sku", "verdict"), ["scene", "main_sku"], "left")
    counts = a.agg(F.count("*").alias("asked"), F.count("verdict").alias("answered"), F.count_if(F.col("verdict") == RELATED).alias("related"), F.count_if(F.col("verdict") == UNRELATED).alias("unrelated"))
    return counts.crossJoin(dropped.agg(F.count("*").alias("dropped")))


def balanced_unique(groups: DataFrame, limit: int) -> DataFrame:
    """Round robin over groups (group_place, place, main_sku): each SKU at its first turn, the first `limit`. Adds turn from 1.

    A SKU's first turn is its least (place, group_place); a sort with a limit, so that no task holds all groups.
    """
    first = groups.groupBy("main_sku").agg(F.min(F.struct("place", "group_place")).alias("t"))
    head = first.select("main_sku", F.col("t.place").alias("place"), F.col("t.group_place").alias("group_place")).orderBy("place", "group_place", "main_sku").limit(limit)
    return head.withColumn("turn", F.row_number().over(W.orderBy("place", "group_place", "main_sku")))


def recommendations(retrieved: DataFrame, judged: DataFrame, least: int) -> DataFrame:
    """Retrieved candidates (scene, product_cn, product_en, main_sku, ...) with a judgment of at least `least`, best first, recall breaking ties."""
    j = retrieved.join(judged.select("scene", "product_cn", "product_en", "main_sku", "relevance"), ["scene", "product_cn", "product_en", "main_sku"]).where(F.col("relevance") >= least)
    w = W.partitionBy("scene", "product_cn", "product_en").orderBy(F.desc("relevance"), "rank")
    return j.withColumn("place", F.row_number().over(w))
