"""Reciprocal-rank fusion of ranked channels, eligibility of children, and query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from .catalog import excluded_main
from .search import ordered_sum, top_k

# The offset of ranks, and the weights of a first and of an expanded query.
OFFSET, PRIMARY, EXPANDED = 60, 1.0, 0.7


def channel_positions(hits: DataFrame, by: list[str]) -> DataFrame:
    """First place of each key in each ranked list; places count every entry. hits: by..., doc, place (from 1)."""
    return hits.groupBy(*by, "doc").agg(F.min("place").alias("place"))


def fuse(hits: DataFrame, *, products: DataFrame | None = None, limit: int | None = None, exclude_mains: bool = False, offset: int = OFFSET) -> DataFrame:
    """(role_id, doc, score, rank, channels, matched_queries, evidence). hits: (role_id, channel, query, weight, doc, place).

    Entries of no product are dropped after places are counted. Sums run in a fixed order; ranks follow the sum to 12 places, ties by key.
    """
    first = channel_positions(hits, ["role_id", "channel", "query", "weight"])
    if products is not None:
        first = first.join(products.select(F.col("main_sku").alias("doc")), "doc", "left_semi")
    if exclude_mains:
        first = first.where(~excluded_main(F.col("doc")))
    part = F.col("weight") / (offset + F.col("place"))
    key = F.concat_ws("\u001f", "channel", "query")
    fused = first.groupBy("role_id", "doc").agg(
        F.round(ordered_sum(F.collect_list(F.struct(key.alias("key"), part.alias("value")))), 12).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"),
        F.array_sort(F.collect_set("query")).alias("matched_queries"), F.array_sort(F.collect_list(F.struct("channel", F.col("place").alias("rank"), "query", "weight"))).alias("evidence"),
    )
    return top_k(fused, limit if limit is not None else 2**31 - 1, by=("role_id",))


def role_terms(roles: DataFrame) -> DataFrame:
    """(role_id, language, query, weight, place): a role's first terms and its expansions, distinct in each language.

    roles: (role_id, product_cn, product_en, canonical_cn, canonical_en, expanded_cn, expanded_en).
    """
    def of(lang: str) -> Column:
        first = F.array(F.struct(F.col(f"canonical_{lang}").alias("query"), F.lit(PRIMARY).alias("weight")), F.struct(F.col(f"product_{lang}").alias("query"), F.lit(PRIMARY).alias("weight")))
        more = F.transform(F.coalesce(F.col(f"expanded_{lang}"), F.array().cast("array<string>")), lambda q: F.struct(q.alias("query"), F.lit(EXPANDED).alias("weight")))
        return F.transform(F.concat(first, more), lambda t: F.struct(F.lit(lang).alias("language"), F.trim(t["query"]).alias("query"), t["weight"].alias("weight")))

    flat = roles.select("role_id", F.posexplode(F.concat(of("cn"), of("en"))).alias("place", "t")).select("role_id", "place", "t.*").where("query is not null and query <> ''")
    w = W.partitionBy("role_id", "language", "query").orderBy("place")
    return flat.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def eligible_children(documents: DataFrame, platform: Column) -> DataFrame:
    """`documents` plus eligible (child SKUs not banned) and warnings; families all of whose children are banned are left out."""
    judged = F.transform(
        F.filter("children", lambda c: ~F.array_contains(c["status_flags"], "excluded_sku")),
        lambda c: F.struct(c["sku"].alias("sku"), c["sales_status_raw"].alias("raw"), tx.platform_banned(tx.status_key(tx.collapse(c["sales_status_raw"])), platform).alias("banned"), tx.status_key(tx.collapse(c["sales_status_raw"])).alias("status")),
    )
    d = documents.withColumn("__j", judged)
    live = F.transform(F.filter("__j", lambda c: ~F.coalesce(c["banned"], F.lit(False))), lambda c: c["sku"])
    warned = F.filter("__j", lambda c: tx.status_warns(c["status"], F.coalesce(c["banned"], F.lit(False)), platform))
    d = d.withColumn("eligible", live).withColumn("warnings", F.array_distinct(F.transform(warned, lambda c: F.concat_ws(": ", c["sku"], c["raw"])))).drop("__j")
    return d.where((F.size("children") == 0) | (F.size("eligible") > 0))


def eligible_rows(children: DataFrame, platform: Column) -> DataFrame:
    """Flat children (catalog.family_children) that `eligible_children` names as eligible."""
    status = tx.status_key(tx.collapse(F.col("sales_status_raw")))
    return children.where(~F.array_contains("status_flags", "excluded_sku") & ~F.coalesce(tx.platform_banned(status, platform), F.lit(False)))


def hybrid_search(hits: DataFrame, documents: DataFrame, limit: int, platform: Column | None = None) -> DataFrame:
    """Fused hits of families that may be sold, refilled past those that may not. A hit without a document is an error."""
    fused = fuse(hits, exclude_mains=True)
    known = documents.select(F.col("main_sku").alias("doc"), F.lit(True).alias("known"))
    checked = fused.join(known, "doc", "left").withColumn("doc", F.when(F.col("known"), F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("missing catalog document for main_sku: "), F.col("doc"))).cast("string")))
    sellable = eligible_children(documents, F.lit(None).cast("string") if platform is None else platform).select(F.col("main_sku").alias("doc"), "eligible", "warnings")
    return top_k(checked.drop("known", "rank").join(sellable, "doc"), limit, by=("role_id",))
