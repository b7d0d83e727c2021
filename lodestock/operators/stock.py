"""Country stock: routing of rows, totals, availability, and what it says about candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

# What came of a role's search.
MATCHED, NO_STOCK, NO_CANDIDATES = "matched", "no_stock_in_recalled_candidates", "no_candidates_in_recall_window"
MEASURES = ("single_sale", "centre", "public_pool", "overseas_transit", "local_transit", "local_stock")


def route_rows(stock: DataFrame, children: DataFrame) -> DataFrame:
    """`stock` (row, child_sku, main_sku, ...) plus expected_main and route: unknown, conflict or ok. children: (child_sku, main_sku)."""
    known = children.select("child_sku", F.col("main_sku").alias("expected_main"))
    j = stock.join(known, "child_sku", "left")
    return j.withColumn("route", F.when(F.col("expected_main").isNull(), "unknown").when(F.col("main_sku") != F.col("expected_main"), "conflict").otherwise("ok"))


def country_rows(stock: DataFrame, children: DataFrame, country: str, *, strict: bool = True) -> DataFrame:
    """(main_sku, child_sku, quantity) of one country's known, agreeing rows: centre plus public pool."""
    code = tx.COUNTRIES.get(country.strip().upper(), tx.COUNTRIES.get(country.strip()))
    if code is None:
        raise ValueError(f"unsupported country: {country!r}")
    ok = route_rows(stock, children).where((F.col("route") == "ok") & (tx.country_code(F.col("country")) == code))
    return ok.select("main_sku", "child_sku", (tx.number(F.col("centre"), strict=strict) + tx.number(F.col("public_pool"), strict=strict)).alias("quantity"))


def totals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main_sku, quantity) over all rows, and (child_sku, quantity) over the positive ones."""
    return rows.groupBy("main_sku").agg(F.sum("quantity").alias("quantity")), rows.where("quantity > 0").groupBy("child_sku").agg(F.sum("quantity").alias("quantity"))


def conflict_note(routed: DataFrame, shown: int = 5) -> DataFrame:
    """One row: conflicts, and the first of them as lines. Only `shown` rows meet."""
    bad = routed.where("route = 'conflict'")
    lines = bad.orderBy("row", "child_sku").limit(shown).select(F.struct("row", "child_sku", F.concat_ws(" ", F.col("row").cast("string"), "child_sku", "expected_main", "main_sku").alias("line")).alias("x"))
    listed = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("examples"))
    return bad.agg(F.count("*").alias("conflicts")).crossJoin(listed)


def availability(rows: DataFrame) -> DataFrame:
    """(country, mains): the distinct mains with stock; a country without any is kept. rows: (country, main_sku, quantity)."""
    return rows.groupBy("country").agg(F.array_sort(F.collect_set(F.when(F.col("quantity") > 0, F.col("main_sku")))).alias("mains"))


def availability_table(rows: DataFrame) -> DataFrame:
    """(country, main_sku) with stock: the form for many mains, in which no row grows with the data."""
    return rows.where("quantity > 0").select("country", "main_sku").distinct()


def snapshot(rows: DataFrame, children: DataFrame, excluded: Column) -> DataFrame:
    """Positive snapshot rows with main_sku resolved and route: excluded, unmatched or matched; a main that disagrees with the catalog is an error."""
    known = children.select("child_sku", F.col("main_sku").alias("mapped"))
    mains = children.select(F.col("main_sku").alias("resolved"), F.lit(True).alias("known")).distinct()
    j = rows.where("quantity > 0").join(known, "child_sku", "left")
    reported = F.nullif(F.trim("main_sku"), F.lit(""))
    wrong = F.col("mapped").isNotNull() & reported.isNotNull() & (reported != F.col("mapped"))
    main = F.when(wrong, F.raise_error(F.concat(F.lit("main SKU disagrees for "), "child_sku")).cast("string")).otherwise(F.coalesce(reported, "mapped"))
    j = j.withColumn("resolved", main).join(mains, "resolved", "left")
    return j.withColumn("route", F.when(excluded, "excluded").when(F.col("known"), "matched").otherwise("unmatched")).drop("known")


def snapshot_counts(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if(F.col("route") == "excluded").alias("excluded_rows"), F.count_if(F.col("route") == "unmatched").alias("unmatched_rows"),
        F.countDistinct(F.when(F.col("route") == "matched", F.col("child_sku"))).alias("available_children"), F.countDistinct(F.when(F.col("route") == "unmatched", F.col("resolved"))).alias("unmatched_mains"),
    )


def measures(rows: DataFrame) -> DataFrame:
    """(country, main_sku, the six sums, available, total), rounded to four places."""
    sums = rows.groupBy("country", "main_sku").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.select(
        "country", "main_sku", *[F.round(m, 4).alias(m) for m in MEASURES], F.round(F.col("centre") + F.col("public_pool"), 4).alias("available"),
        F.round(F.col("centre") + F.col("public_pool") + F.col("overseas_transit") + F.col("local_transit") + F.col("local_stock"), 4).alias("total"),
    )


def annotate(candidates: DataFrame, stock: DataFrame | None) -> DataFrame:
    """Candidates plus country_available and country_available_quantity; both null when no stock was read."""
    if stock is None:
        return candidates.withColumn("country_available_quantity", F.lit(None).cast("double")).withColumn("country_available", F.lit(None).cast("boolean"))
    j = candidates.join(stock.select("main_sku", F.col("quantity").alias("__q")), "main_sku", "left")
    has = F.coalesce(F.col("__q") > 0, F.lit(False))
    return j.withColumn("country_available_quantity", F.when(has, F.round("__q", 4))).withColumn("country_available", has).drop("__q")


def first_in_stock(annotated: DataFrame, limit: int, by: tuple[str, ...] = ("role_id",)) -> DataFrame:
    """The first `limit` candidates of each role that are in stock, by rank."""
    w = W.partitionBy(*by).orderBy("rank")
    return annotated.where("country_available").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def cut(annotated: DataFrame, limit: int, *, in_stock_only: bool, by: tuple[str, ...] = ("role_id",)) -> DataFrame:
    """Recall's head: in-stock candidates only if asked, ranked anew, the first `limit`."""
    rows = annotated.where("country_available") if in_stock_only else annotated
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("rank"))).where(F.col("rank") <= limit)


def match_status(roles: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(role_id, candidate_count_before_stock, match_status), which tells nothing recalled from nothing in stock."""
    a, b = (d.groupBy("role_id").agg(F.count("*").alias(n)) for d, n in ((before, "found"), (after, "left")))
    j = roles.select("role_id").distinct().join(a, "role_id", "left").join(b, "role_id", "left")
    found, left = F.coalesce("found", F.lit(0)), F.coalesce("left", F.lit(0))
    return j.select("role_id", found.alias("candidate_count_before_stock"), F.when(left > 0, MATCHED).when(found > 0, NO_STOCK).otherwise(NO_CANDIDATES).alias("match_status"))
