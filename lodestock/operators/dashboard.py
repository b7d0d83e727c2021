"""What a dashboard shows of a retrieval: scenes with their products, each with its groups of candidates, in one nested select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is shown of a candidate and of a product, and the groups of a first and of a final result.
CANDIDATE_FIELDS = ("rank", "main_sku", "standard_name_cn", "standard_name_en", "rrf_score", "country_available_quantity", "country_available", "relevance", "rerank_reason")
PRODUCT_FIELDS = ("product_cn", "product_en", "canonical_cn", "canonical_en", "expanded_cn", "expanded_en")
GROUPS = {False: ("global_candidates", "country_candidates"), True: ("related_candidates", "country_recommendations", "raw_global_candidates")}


def retrieval_view(roles: DataFrame, candidates: DataFrame, *, final: bool = False) -> DataFrame:
    """(scene_name, products): a row a scene, its products in order of place with the fields shown and their groups of candidates by rank.

    roles: (scene_name, place, product fields); candidates: (scene_name, product_cn, product_en, group, candidate fields). What a table
    lacks is shown as null, a product without candidates has empty groups, groups that are not shown are left out. A group holds a search's limit of candidates at most.
    """
    keys = ["scene_name", "product_cn", "product_en"]
    shown = lambda df, names: [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
    mine = candidates.where(F.col("group").isin(*GROUPS[final]))
    item = F.struct(*shown(candidates, CANDIDATE_FIELDS))
    grouped = mine.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("group") == g, item))).alias(g) for g in GROUPS[final]])
    none = F.array().cast(grouped.schema[GROUPS[final][0]].dataType)
    r = roles.select("scene_name", "place", *shown(roles, PRODUCT_FIELDS)).alias("r")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    product = F.struct(F.col("r.place").alias("place"), *[F.col(f"r.{p}").alias(p) for p in PRODUCT_FIELDS], *[F.coalesce(F.col(f"g.{g}"), none).alias(g) for g in GROUPS[final]])
    joined = r.join(grouped.alias("g"), on, "left").select(F.col("r.scene_name").alias("scene_name"), product.alias("p"))
    names = (*PRODUCT_FIELDS, *GROUPS[final])
    products = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(*[p[n].alias(n) for n in names]))
    return joined.groupBy("scene_name").agg(products.alias("products"))
