"""Partial upserts: incoming rows against stored ones, merged families, reports, and the queue of names to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import canonical_hash
from .catalog import excluded_main

# Which evidence fields make up each part of a review.
EVIDENCE = {"cn_names": ("product_name",), "english": ("english_name", "english_keywords"), "categories": ("product_catalog", "category_level_1", "category_level_2", "category_level_3", "category_level_4")}


def with_hashes(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows plus row_hash over all named cells and evidence_hash over the review's."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = [c for part in EVIDENCE.values() for c in part if c in rows.columns]
    return rows.withColumn("row_hash", canonical_hash({c: cell(c) for c in columns})).withColumn("evidence_hash", canonical_hash({c: cell(c) for c in seen}))


def distinct_children(rows: DataFrame) -> DataFrame:
    """One row a child; rows of one child that differ are an error. rows: sku, row_hash, ord, ..."""
    g = rows.groupBy("sku").agg(F.min_by(F.struct(*rows.columns), "ord").alias("r"), F.countDistinct("row_hash").alias("n"))
    wrong = F.raise_error(F.concat(F.lit("conflicting duplicate child rows: "), "sku"))
    return g.withColumn("ok", F.when(F.col("n") > 1, wrong.cast("boolean")).otherwise(F.lit(True))).where("ok").select("r.*")


def compare_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming plus change: new, changed or same. A child that moved to another main is an error. Both: sku, main_sku, row_hash."""
    old = stored.select("sku", F.col("main_sku").alias("old_main"), F.col("row_hash").alias("old_hash"))
    j = incoming.join(old, "sku", "left")
    moved = F.col("old_main").isNotNull() & (F.col("old_main") != F.col("main_sku"))
    change = F.when(moved, F.raise_error(F.concat(F.lit("child SKU reparent is not allowed: "), "sku")).cast("string")).when(F.col("old_main").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("row_hash")), "same").otherwise("changed")
    return j.withColumn("change", change).drop("old_main", "old_hash")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows win, absent ones stay; nothing is deleted."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def merge_documents(current: DataFrame, built: DataFrame) -> DataFrame:
    """Families after an import: a known one keeps names and text and takes its children's new state, new children behind the old in order of SKU; a new one is as built."""
    c = current.select("main_sku", F.struct(*current.columns).alias("old"))
    b = built.select("main_sku", F.struct(*built.columns).alias("new"))
    j = c.join(b, "main_sku", "full_outer")
    key = lambda x: tx.collapse(x["sku"])
    kept = F.transform("old.children", lambda o: F.coalesce(F.get(F.filter("new.children", lambda n: key(n) == key(o)), F.lit(0)), o))
    more = F.filter("new.children", lambda n: ~F.exists("old.children", lambda o: key(o) == key(n)))
    more = F.transform(F.array_sort(F.transform(more, lambda n: F.struct(key(n).alias("k"), n.alias("n")))), lambda x: x["n"])
    children = F.when(F.col("new").isNull(), F.col("old.children")).when(F.col("old").isNull(), F.col("new.children")).otherwise(F.concat(kept, more))
    pick = lambda name: F.when(F.col("old").isNull(), F.col("new")[name]).otherwise(F.col("old")[name])
    return j.select(*[children.alias(c) if c == "children" else pick(c).alias(c) for c in current.columns])


def merge_children(current: DataFrame, built: DataFrame) -> DataFrame:
    """The children of `merge_documents` as rows, joined by key, so that a family may be of any size. Both as catalog.family_children gives them; place is the one after the import."""
    key = tx.collapse(F.col("sku"))
    old, new = current.withColumn("__k", key), built.withColumn("__k", key)
    rest = [c for c in current.columns if c not in ("main_sku", "place")]
    state = new.groupBy("main_sku", "__k").agg(F.min(F.struct("place", *rest)).alias("__new"))
    kept = old.join(state, ["main_sku", "__k"], "left").select("main_sku", F.lit(0).alias("__part"), "place", *[F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.col("__new")[c]).alias(c) for c in rest])
    known = old.select("main_sku").distinct().withColumn("__known", F.lit(True))
    more = new.join(old.select("main_sku", "__k").distinct(), ["main_sku", "__k"], "left_anti").join(known, "main_sku", "left")
    more = more.select("main_sku", F.lit(1).alias("__part"), F.when(F.col("__known"), F.struct("__k", *rest)).alias("__by"), "place", *rest)  # a new family's are in their own order
    order = W.partitionBy("main_sku").orderBy("__part", "__by", "place")
    return kept.unionByName(more, allowMissingColumns=True).withColumn("place", F.row_number().over(order) - 1).select(*current.columns)


def changed_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """(main_sku) of documents that are new or differ."""
    whole = lambda d, n: d.select("main_sku", F.sha2(F.to_json(F.struct(*sorted(d.columns))), 256).alias(n))
    return whole(after, "now").join(whole(before, "was"), "main_sku", "left").where(~F.col("now").eqNullSafe(F.col("was"))).select("main_sku")


def upsert_report(incoming: DataFrame, stored: DataFrame, excluded: Column | None = None) -> DataFrame:
    """One row of counters: rows in, children new, existing, changed, retained, mains new, existing, retained, excluded."""
    i = incoming.join(stored.select("sku", F.col("row_hash").alias("old_hash"), F.lit(True).alias("had")), "sku", "left")
    of_rows = i.agg(
        F.count("*").alias("source_rows"), F.count_if(F.col("had").isNull()).alias("new_children"), F.count_if(F.col("had").isNotNull()).alias("existing_children"),
        F.count_if(F.col("had") & ~F.col("old_hash").eqNullSafe(F.col("row_hash"))).alias("changed_children"), F.count_if(excluded_main(F.col("main_sku")) if excluded is None else excluded).alias("excluded_rows"),
    )
    mains = lambda d, n: d.select("main_sku").distinct().withColumn(n, F.lit(True))
    m = mains(incoming, "now").join(mains(stored, "was"), "main_sku", "full_outer")
    of_mains = m.agg(F.count_if(F.col("now") & F.col("was").isNull()).alias("new_mains"), F.count_if(F.col("now") & F.col("was")).alias("existing_mains"), F.count_if(F.col("now").isNull()).alias("retained_mains"))
    left = stored.join(mains(incoming, "now"), "main_sku").join(incoming.select("sku"), "sku", "left_anti").agg(F.count("*").alias("retained_children"))
    return of_rows.crossJoin(of_mains).crossJoin(left)  # three single rows


def review_evidence(rows: DataFrame) -> DataFrame:
    """(main_sku, cn_names, english, categories, evidence_hash): the distinct usable values of each part."""
    parts = []
    for name, columns in EVIDENCE.items():
        values = F.array_compact(F.array(*[tx.clean_optional(tx.collapse(F.coalesce(F.col(c), F.lit("")))) for c in columns if c in rows.columns]))
        parts.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(name))
    g = rows.groupBy("main_sku").agg(*parts)
    return g.withColumn("evidence_hash", canonical_hash({n: F.col(n) for n in EVIDENCE}))


def needs_review(incoming: DataFrame, stored: DataFrame, current_mains: DataFrame) -> DataFrame:
    """(main_sku): families that are new, or whose evidence changed in some child. incoming, stored: sku, main_sku, evidence_hash, and the name fields."""
    named = F.lit(False)
    for c in ("product_name", "english_name", "english_keywords"):
        if c in incoming.columns:
            named = named | tx.clean_optional(tx.collapse(F.coalesce(F.col(c), F.lit("")))).isNotNull()
    i = incoming.where(~excluded_main(F.col("main_sku")))
    i = i.join(i.where(named).select("main_sku").distinct(), "main_sku", "left_semi")
    j = i.join(stored.select("sku", F.col("evidence_hash").alias("old")), "sku", "left").join(current_mains.select("main_sku", F.lit(True).alias("known")).distinct(), "main_sku", "left")
    return j.where(F.col("known").isNull() | ~F.col("old").eqNullSafe(F.col("evidence_hash"))).select("main_sku").distinct()


def refresh_queue(queue: DataFrame, evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """The review queue (main_sku, evidence_hash, status) after an import: a reviewed name whose evidence is the same isn't opened again."""
    new = evidence.join(wanted, "main_sku", "left_semi").select("main_sku", F.col("evidence_hash").alias("now"))
    j = queue.join(new, "main_sku", "full_outer")
    done = F.col("now").isNull() | ((F.col("status") == "reviewed") & (F.col("evidence_hash") == F.col("now")))
    return j.select("main_sku", F.when(done, F.col("evidence_hash")).otherwise(F.col("now")).alias("evidence_hash"), F.when(done, F.col("status")).otherwise("pending").alias("status"))


def apply_reviews(queue: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Marks entries reviewed whose evidence is what the reviewer saw; an answer to other evidence is an error."""
    r = reviewed.select("main_sku", F.col("evidence_hash").alias("seen"))
    j = queue.join(r, "main_sku", "left")
    stale = F.col("seen").isNotNull() & (F.col("seen") != F.col("evidence_hash"))
    status = F.when(stale, F.raise_error(F.concat(F.lit("stale review: "), "main_sku")).cast("string")).when(F.col("seen").isNotNull(), "reviewed").otherwise(F.col("status"))
    return j.select("main_sku", "evidence_hash", status.alias("status"))


def pending(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").orderBy("main_sku")
