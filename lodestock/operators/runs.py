"""Runs of a store's stages: what is out of date, what is left to do, what it cost, and what may be shown or exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Candidates that a judge is shown, and their fields.
JUDGED, JUDGED_FIELDS = 80, {"main_sku": "main_sku", "cn": "standard_name_cn", "en": "standard_name_en", "rank": "rank"}
# Why a store can't be exported yet, in the order in which they are looked at.
BLOCKED = ("running", "no_retrieval", "no_child_stock", "outdated")


def stale_stages(stages: DataFrame, stores: DataFrame, files: DataFrame, finished: DataFrame, recorded: DataFrame, settings: DataFrame, unread: DataFrame) -> DataFrame:
    """(store, stage, place, behind): a stage is behind if it hasn't finished, its file is missing or older than its source, a setting
    it ran with has changed, pictures are unread (first stage), or an earlier stage is behind.

    stages: (place, stage, source, made), a source null where no file is read; stores: (store); files: (store, name, modified); finished: (store, stage);
    recorded: (store, stage, key, value) of runs that noted their settings; settings: (store, key, value); unread: (store).
    """
    due = stores.crossJoin(F.broadcast(stages))  # some eight rows
    made = files.select("store", F.col("name").alias("made"), F.col("modified").alias("made_at"))
    read = files.select("store", F.col("name").alias("source"), F.col("modified").alias("read_at"))
    changed = recorded.join(settings.withColumnRenamed("value", "now"), ["store", "key"], "left").where(~F.col("value").eqNullSafe(F.col("now")))
    marks = [finished.select("store", "stage").distinct().withColumn("done", F.lit(True)), changed.select("store", "stage").distinct().withColumn("changed", F.lit(True))]
    j = due.join(made, ["store", "made"], "left").join(read, ["store", "source"], "left")
    for m in marks:
        j = j.join(m, ["store", "stage"], "left")
    j = j.join(unread.select("store").distinct().withColumn("unread", F.lit(True)), "store", "left")
    own = F.col("done").isNull() | F.col("made_at").isNull() | F.coalesce(F.col("read_at") > F.col("made_at"), F.lit(False)) | F.col("changed").isNotNull() | (F.col("unread").isNotNull() & (F.col("place") == 0))
    behind = F.max(own).over(W.partitionBy("store").orderBy("place"))
    return j.select("store", "stage", "place", behind.alias("behind"))


def next_stages(states: DataFrame) -> DataFrame:
    """(store, next_stage, stages_left): the first stage that is behind, null where the store is ready, and how many are. states: (store, stage, place, behind)."""
    first = F.min(F.when(F.col("behind"), F.struct("place", "stage")))
    return states.groupBy("store").agg(first.alias("first"), F.count_if("behind").alias("stages_left")).select("store", F.col("first.stage").alias("next_stage"), "stages_left")


def store_batches(stores: DataFrame, size: int) -> DataFrame:
    """`stores` (store, country, ...) plus batch, from 0: `size` stores of one country each, in order of the store."""
    w = W.partitionBy("country").orderBy("store")
    return stores.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def unread_pictures(pictures: DataFrame, receipts: DataFrame) -> DataFrame:
    """(store): stores with a picture (store, picture) that the reading's receipt (store, picture) doesn't name."""
    return pictures.join(receipts.select("store", "picture").distinct(), ["store", "picture"], "left_anti").select("store").distinct()


def usage_totals(usage: DataFrame, *by: str) -> DataFrame:
    """(by..., key, total, note): whole numbers are added up; anything else replaces what was there, and is replaced by what follows. usage: by..., key, ord, amount (long) or note."""
    keys = [*by, "key"]
    other = F.col("amount").isNull()
    last = usage.where(other).groupBy(*keys).agg(F.max(F.struct("ord", "note")).alias("last"))
    after = usage.where(~other).join(last, keys, "left").where(F.col("last").isNull() | (F.col("ord") > F.col("last.ord"))).groupBy(*keys).agg(F.sum("amount").alias("total"))
    both = last.join(after, keys, "full_outer")
    return both.select(*keys, "total", F.when(F.col("total").isNull(), F.col("last.note")).alias("note"))


def merged_receipts(receipts: DataFrame, usage: DataFrame) -> DataFrame:
    """(store, stage, calls, usage): calls of a stage and its whole numbers by key. receipts: (store, stage, call); usage: (store, stage, key, amount)."""
    spent = usage.where("amount is not null").groupBy("store", "stage", "key").agg(F.sum("amount").alias("total"))
    of_stage = spent.groupBy("store", "stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "total")))).alias("usage"))
    calls = receipts.groupBy("store", "stage").agg(F.count("*").alias("calls"))
    return calls.join(of_stage, ["store", "stage"], "left")


def unfinished(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of the scenes to make those without a result that may be reused. wanted: (store, scene, request); manifest: (store, scene, request, recorded, found).

    A result is reused if it was made for the same request and its content still has the digest that was recorded.
    """
    names = wanted.groupBy("store", "scene").agg(F.count("*").alias("n"), F.min("request").alias("request"))
    once = names.select("store", "scene", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a scene is named twice: "), "scene")).cast("string")).otherwise(F.col("request").cast("string")).alias("request"))
    good = manifest.where(F.col("recorded") == F.col("found")).select("store", "scene", F.col("request").cast("string").alias("request")).distinct()
    return once.join(good, ["store", "scene", "request"], "left_anti")


def export_blocked(stores: DataFrame) -> DataFrame:
    """`stores` plus blocked: the first reason of BLOCKED, null if the store may be exported. stores: ..., status, has_retrieval, has_child_stock, outdated."""
    reasons = (F.col("status").isin("pending", "running"), ~F.col("has_retrieval"), ~F.col("has_child_stock"), F.col("outdated"))
    out: Column | None = None
    for name, reason in zip(BLOCKED, reasons):
        out = F.when(reason, name) if out is None else out.when(reason, name)
    return stores.withColumn("blocked", out)


def for_judging(candidates: DataFrame, *by: str, most: int = JUDGED, fields: dict[str, str] = JUDGED_FIELDS) -> DataFrame:
    """(by..., candidates): the first `most` of each role in order of rank, with the fields that a judge reads. A role's array has at most `most` entries."""
    head = candidates.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy("rank", "main_sku"))).where(F.col("n") <= most)
    item = F.struct("n", F.struct(*[F.col(c).alias(name) for name, c in fields.items()]).alias("c"))
    return head.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("candidates"))


def visible(candidates: DataFrame, mode: str) -> DataFrame:
    """Rows that a view shows: all, in_stock or picked. candidates: ..., country_available, picked."""
    if mode not in ("all", "in_stock", "picked"):
        raise ValueError(f"unknown view: {mode}")
    return candidates if mode == "all" else candidates.where(F.coalesce(F.col("picked" if mode == "picked" else "country_available"), F.lit(False)))


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds rows to the record of imports; files that are there are left alone."""
    rows.write.mode("append").parquet(path)
