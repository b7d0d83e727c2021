"""Reports: picks, scene blocks, buy lists, children with stock, export rows, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NO_CHILD, NO_CHILD_NAME, NOT_READ = "—", "产品库中未登记子款", "未核验"


def joined(rows: DataFrame, keys: list[str], place: str, value: str, separator: str, run: int = 1024) -> DataFrame:
    """(keys, joined): values of a key in order of `place`, a whole number from 0 that no two share, as one text. Runs of places are joined first, so that no list of single values is longer than a run."""
    listed = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator)
    runs = rows.groupBy(*keys, F.floor(F.col(place) / run).alias("__run")).agg(listed(place, value).alias("__text"))
    return runs.groupBy(*keys).agg(listed("__run", "__text").alias("joined"))


def recalled(candidates: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """One row a (scene, role, main_sku); of several the last wins, dropped ones last."""
    rows = candidates.withColumn("__late", F.lit(0))
    if dropped is not None:
        rows = rows.unionByName(dropped.withColumn("__late", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy("scene", "role", "main_sku").orderBy(F.desc("__late"), F.desc("rank"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__late")


def picked(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Candidates that were picked; a pick that was never recalled has no effect."""
    return candidates.join(picks.select("scene", "role", "main_sku").distinct(), ["scene", "role", "main_sku"], "left_semi")


def buy_list(chosen: DataFrame) -> DataFrame:
    """One row a SKU: its first candidate, and every use in order. chosen: scene, scene_place, role, role_place, rank, main_sku, name, quantity."""
    use = F.struct("scene_place", "role_place", "rank", F.concat_ws(" · ", "scene", "role").alias("use"))
    place = F.struct("scene_place", "role_place", "rank")
    g = chosen.groupBy("main_sku").agg(F.min(place).alias("place"), F.min_by("name", place).alias("name"), F.min_by("quantity", place).alias("quantity"), F.array_sort(F.collect_list(use)).alias("uses"))
    return g.select("main_sku", "name", "quantity", F.array_join(F.transform("uses", lambda u: u["use"]), "\n").alias("uses"), F.col("place.scene_place").alias("scene_place"), F.col("place.role_place").alias("role_place"), F.col("place.rank").alias("rank"))


def scene_blocks(chosen: DataFrame) -> DataFrame:
    """(scene, main_sku, name, quantity, rank, line): a SKU once a scene at its best rank; most stock first, then rank, then SKU."""
    order = F.struct("rank", "role_place")
    g = chosen.groupBy("scene", "main_sku").agg(F.min("rank").alias("rank"), F.min_by("name", order).alias("name"), F.min_by("quantity", order).alias("quantity"))
    w = W.partitionBy("scene").orderBy(F.desc(F.coalesce("quantity", F.lit(0.0))), "rank", "main_sku")
    return g.withColumn("line", F.row_number().over(w))


def child_rows(bought: DataFrame, children: DataFrame, stock: DataFrame | None) -> DataFrame:
    """One row a child of every bought SKU, most stock first, then the catalog's order; a SKU without children keeps a line saying so.

    bought: (main_sku, name, uses); children: (main_sku, place, child_sku, child_name); stock: (child_sku, quantity), None if it was not read.
    """
    j = bought.select("main_sku", "name", "uses").join(children.select("main_sku", "place", "child_sku", "child_name"), "main_sku", "left")
    j = j.join(stock.select("child_sku", "quantity"), "child_sku", "left") if stock is not None else j.withColumn("quantity", F.lit(None).cast("double"))
    w = W.partitionBy("main_sku").orderBy(F.desc(F.coalesce("quantity", F.lit(0.0))), "place")
    j = j.withColumn("line", F.row_number().over(w))
    shown = F.coalesce("quantity", F.lit(0.0)).cast("string") if stock is not None else F.lit(NOT_READ)
    none = F.col("child_sku").isNull()
    return j.select("main_sku", "name", F.coalesce("child_sku", F.lit(NO_CHILD)).alias("child_sku"), F.when(none, NO_CHILD_NAME).otherwise(F.coalesce("child_name", F.lit(""))).alias("child_name"), shown.alias("quantity"), "uses", "line")


def with_metrics(recommended: DataFrame, metrics: DataFrame, covered: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Recommendations (country, main_sku, ...) plus metrics: 0 where a covered country has no row, null where it isn't covered."""
    j = recommended.join(metrics, ["country", "main_sku"], "left").join(covered.select("country", F.lit(True).alias("__covered")).distinct(), "country", "left")
    shown = [F.when(F.col("__covered"), F.coalesce(c, F.lit(0.0))).alias(c) for c in columns]
    return j.select(*recommended.columns, *shown, F.when(F.col("__covered"), F.col(columns[0]).isNotNull()).alias("exists"))


def latest_review(rows: DataFrame) -> DataFrame:
    return rows.groupBy("main_sku").agg(F.max("reviewed_at").alias("latest_review"))


def selected(candidates: DataFrame, row: DataFrame, role: DataFrame, scene: DataFrame, default: Column) -> DataFrame:
    """Whether each candidate is selected: its own override, else its role's, else its scene's, else the default."""
    j = candidates.join(row.select("scene", "role", "main_sku", F.col("on").alias("__row")), ["scene", "role", "main_sku"], "left")
    j = j.join(role.select("scene", "role", F.col("on").alias("__role")), ["scene", "role"], "left").join(scene.select("scene", F.col("on").alias("__scene")), "scene", "left")
    return j.withColumn("selected", F.coalesce("__row", "__role", "__scene", default)).drop("__row", "__role", "__scene")


def up_to(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """'This row and everything above it': candidates of a role up to the marked rank. marks: (scene, role, upto)."""
    return candidates.join(marks, ["scene", "role"]).where("rank <= upto").drop("upto")


def top_summary(candidates: DataFrame, n: int = 5) -> DataFrame:
    """(scene, role, line): the first n of each role as text."""
    head = candidates.where(F.col("rank") <= n)
    return head.groupBy("scene", "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "main_sku"))), lambda x: x["main_sku"]), ", ").alias("line"))


def counts_per_scene(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scene").agg(F.countDistinct("main_sku").alias("distinct_skus"), F.count("*").alias("rows"))


def provenance(facts: dict[str, str], spark) -> DataFrame:
    """(place, fact, value) lines of what a report was made from."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(facts.items())], "place int, fact string, value string")
