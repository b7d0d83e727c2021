"""Quality gates: duplicate keys, rows lost or invented between source and documents, counters, hashes, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import percent_change
from .catalog import children_of

METRICS = ("source_row_count", "child_count", "document_count", "searchable_document_count", "multi_variant_group_count", "missing_product_name_count", "placeholder_product_name_count", "mixed_category_document_count", "exact_document_collision_count")


def duplicate_keys(df: DataFrame, key: Column, raw: Column) -> DataFrame:
    """(key, n, raws): keys that occur twice or more, with how each was written."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(raw)).alias("raws")).where("n > 1")


def multiset_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts differ: keys, left_count, right_count, kind (missing, extra or count)."""
    a, b = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((left, "left_count"), (right, "right_count")))
    joined = a.join(b, keys, "full_outer").select(*keys, F.coalesce("left_count", F.lit(0)).alias("left_count"), F.coalesce("right_count", F.lit(0)).alias("right_count"))
    kind = F.when(F.col("right_count") == 0, "missing").when(F.col("left_count") == 0, "extra").otherwise("count")
    return joined.where("left_count <> right_count").withColumn("kind", kind)


def identifier_leaks(documents: DataFrame) -> DataFrame:
    """(main_sku, identifier): ids of a searchable document that stand in its vector text."""
    ids = documents.where("searchable").select("main_sku", "vector_text_v1", F.explode(F.concat(F.array("main_sku"), F.transform("children", lambda c: tx.collapse(c["sku"])))).alias("identifier"))
    return ids.where(tx.mentions_identifier(F.col("vector_text_v1"), F.col("identifier"))).select("main_sku", "identifier")


def semantic_json() -> Column:
    """What of a document can affect retrieval."""
    sort = lambda c: F.array_sort(c)
    return F.to_json(F.struct(F.col("searchable"), sort(F.col("cn_names")).alias("cn_names"), sort(F.col("en_aliases")).alias("en_aliases"), sort(F.col("leaf_categories")).alias("leaf_categories"), sort(F.col("category_paths")).alias("category_paths"), F.col("vector_text_v1")))


def document_metrics(documents: DataFrame) -> DataFrame:
    """One row of counters, of which collisions are the documents beyond the first of each meaning. Documents are read once; `catalog.family_heads`, which count their children, do as well."""
    size = F.size("children") if documents.schema["children"].dataType.typeName() == "array" else F.col("children")
    of_meaning = documents.groupBy(F.sha2(semantic_json(), 256).alias("meaning")).agg(
        F.count("*").alias("documents"), F.sum(size).alias("children"), F.count_if("searchable").alias("searchable"), F.count_if(size > 1).alias("many"), F.count_if(F.array_contains("quality_flags", "mixed_leaf_category")).alias("mixed")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return of_meaning.agg(
        total("children").alias("child_count"), total("documents").alias("document_count"), total("searchable").alias("searchable_document_count"), total("many").alias("multi_variant_group_count"),
        total("mixed").alias("mixed_category_document_count"), total(F.col("documents") - 1).alias("exact_document_collision_count"),
    )


def quality_metrics(rows: DataFrame, documents: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """One row of METRICS. Each part is one aggregate row, so the joins between them are of single rows."""
    name = tx.normalize_compare(F.col("product_name"), ascii_only=ascii_only)
    of_rows = rows.agg(F.count("*").alias("source_row_count"), F.count_if(name == "").alias("missing_product_name_count"), F.count_if((name != "") & tx.is_placeholder(name)).alias("placeholder_product_name_count"))
    return of_rows.crossJoin(document_metrics(documents)).select(*METRICS)


def dataset_hash(documents: DataFrame, *columns: str) -> DataFrame:
    """One row, content_sha256: the same whatever the order of rows. Row hashes are folded per leading hex digits first, so no task and no row holds them all."""
    lines = documents.select(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256).alias("h"))
    part = lines.groupBy(F.substring("h", 1, 4).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("content_sha256"))


def validate_build(rows: DataFrame, documents: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """(error, detail): everything that blocks a build; empty when it may go out."""
    r = rows.select(tx.normalize_compare(F.col("main_sku"), ascii_only=ascii_only).alias("main_sku"), tx.normalize_compare(F.col("sku"), ascii_only=ascii_only).alias("sku"), F.col("sku").alias("raw"))
    c = children_of(documents).select("main_sku", tx.normalize_compare(F.col("sku"), ascii_only=ascii_only).alias("sku"), F.col("sku").alias("raw"))
    mains = lambda d: d.select("main_sku").distinct()
    as_error = lambda d, label, detail: d.select(F.lit(label).alias("error"), detail.alias("detail"))
    pair = F.concat_ws("/", "main_sku", "sku")
    parts = [
        as_error(duplicate_keys(r, F.col("sku"), F.col("raw")), "duplicate child sku", F.col("key")), as_error(duplicate_keys(documents, F.col("main_sku"), F.col("main_sku")), "duplicate document main sku", F.col("key")),
        as_error(duplicate_keys(c, F.col("sku"), F.col("raw")), "duplicate document child sku", F.col("key")), multiset_diff(r, c, ["main_sku", "sku"]).select(F.concat(F.col("kind"), F.lit(" child sku")).alias("error"), pair.alias("detail")),
        as_error(mains(r).join(mains(documents), "main_sku", "left_anti"), "missing document", F.col("main_sku")), as_error(mains(documents).join(mains(r), "main_sku", "left_anti"), "extra document", F.col("main_sku")),
        as_error(identifier_leaks(documents), "vector text contains identifier", F.concat_ws("/", "main_sku", "identifier")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_quality(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, previous, current, absolute_delta, percentage_delta) of two rows of METRICS."""
    tall = lambda d, n: d.select(F.stack(F.lit(len(METRICS)), *[x for m in METRICS for x in (F.lit(m), F.col(m).cast("long"))]).alias("metric", n))
    j = tall(current, "current").join(tall(previous, "previous"), "metric", "left")
    return j.select("metric", "previous", "current", (F.col("current") - F.coalesce("previous", F.lit(0))).alias("absolute_delta"), percent_change(F.col("previous"), F.col("current")).alias("percentage_delta"))
