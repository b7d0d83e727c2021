"""Clues read from screenshots, operators' choices about them, sales rows, expansions, and validators of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scalars import count_or_amount

# The roles of a product in a picture, strongest first, and the role of one added by hand.
CARD, UNSURE, SCENERY, MANUAL = "商品卡片主图", "不确定", "场景中偶然出现", "运营手动添加"


def role_strength(role: Column) -> Column:
    return F.when(role == CARD, 2).when(role == UNSURE, 1).otherwise(0)


def merge_clues(seen: DataFrame) -> DataFrame:
    """One row a clue. seen: (name, image, image_place, place, role, confidence, evidence); a listed name counts for each of its parts.

    Role, confidence and evidence are of the strongest occurrence, the first of equal ones; pictures in order of appearance.
    """
    each = seen.select("*", F.explode(tx.split_clue(F.col("name"))).alias("clue"))
    order = F.struct("image_place", "place")
    best = F.struct(role_strength(F.col("role")), "confidence", (-F.col("image_place")).alias("i"), (-F.col("place")).alias("p"))
    g = each.groupBy("clue").agg(
        F.max_by(F.struct("role", "confidence", "evidence"), best).alias("b"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "image"))).alias("found"), F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set(F.when(F.col("name") != F.col("clue"), F.col("name")))).alias("merged_from"),
        F.countDistinct("image").alias("image_count"), F.count_if(F.col("role") == CARD).alias("card_images"), F.count_if(F.col("role") == SCENERY).alias("scenery_images"),
    )
    return g.select("clue", "b.role", F.round("b.confidence", 4).alias("confidence"), "b.evidence", F.array_distinct(F.transform("found", lambda x: x["image"])).alias("images"), "occurrences", "merged_from", "image_count", "card_images", "scenery_images")


def review_clues(clues: DataFrame, excluded: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Clues plus excluded and manual; products added by hand (ord, name_cn) follow unless a picture shows them already."""
    rows = clues.withColumn("manual", F.lit(False))
    if manual is not None:
        named = manual.select("ord", F.trim("name_cn").alias("clue")).where("clue <> ''")
        first = named.groupBy("clue").agg(F.min("ord").alias("ord")).join(clues.select("clue"), "clue", "left_anti")
        rows = rows.unionByName(first.select("clue", F.lit(MANUAL).alias("role"), F.lit(0.0).alias("confidence"), F.lit(True).alias("manual")), allowMissingColumns=True)
    marks = excluded.select("clue", F.lit(True).alias("__x")).distinct()
    return rows.join(marks, "clue", "left").withColumn("excluded", F.coalesce("__x", F.lit(False))).drop("__x")


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.agg(F.count_if(~F.col("excluded")).alias("kept"), F.count_if("excluded").alias("excluded"))


def analysis_input(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept clues with what a scene may be built from, and the excluded ones with the reason."""
    return reviewed.where("not excluded").select("clue", "role", "confidence", "evidence"), reviewed.where("excluded").select("clue", F.lit("运营手动排除").alias("reason"))


def mention_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text, name): every pair of a text and a name that it mentions, as tx.mentions has it, each once. texts: (text); names: (name).

    Pairs meet by a Latin word that both have, or by one pair of neighbouring CJK characters of the name's run: of each run that which is
    rarest among the texts, so that common ones bring few candidates, which are verified on the whole run. Keys are joined by shuffle; none is collected.
    """
    texts, names = texts.select("text").where("text is not null").distinct(), names.select("name").where("name is not null").distinct()
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z]{2,})"), F.lit(1)))).alias("key")
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({tx.CJK}{{2,}})"), F.lit(1)))
    twos = lambda run: F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    by_word = texts.select("text", words(F.col("text"))).join(names.select("name", words(F.col("name"))), "key").select("text", "name")
    grams = texts.select("text", F.explode(F.array_distinct(F.flatten(F.transform(runs(F.col("text")), twos)))).alias("key"))
    often = grams.groupBy("key").agg(F.count("*").alias("n"))
    parts = names.select("name", F.explode(runs(F.col("name"))).alias("run"))
    keyed = parts.select("name", "run", F.explode(F.array_distinct(twos(F.col("run")))).alias("key"))
    rarest = keyed.join(often, "key", "left").groupBy("name", "run").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    by_run = grams.join(rarest, "key").where(F.contains("text", F.col("run"))).select("text", "name")
    return by_word.unionByName(by_run).distinct()


def purity_violations(needs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(scene, product_cn, excluded_clue): needs that mention an excluded clue, a row for each row of `needs` and clue. Any number of either."""
    text = tx.product_text(F.col("product_cn"), F.col("product_en"))
    told = needs.select("scene", "product_cn", text.alias("text"))
    pairs = mention_pairs(told, excluded.select(F.col("clue").alias("name")))
    return told.join(pairs, "text").select("scene", "product_cn", F.col("name").alias("excluded_clue"))


def drop_image(seen: DataFrame, image: str) -> DataFrame:
    return seen.where(~F.col("image").eqNullSafe(F.lit(image)))


def unread_images(images: DataFrame, read: DataFrame) -> DataFrame:
    return images.join(read.select("image"), "image", "left_anti")


def sales_rows(raw: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings) of sales read from pictures: the first `most` of each picture; a metric that is no number is nulled and warned of; nothing is summed."""
    w = W.partitionBy("image").orderBy("source_row")
    head = raw.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    metrics = {"orders": True, "units_sold": True, "gmv": False}
    parsed = head.select("*", *[count_or_amount(F.col(m), integer=i).alias(f"__{m}") for m, i in metrics.items()])
    bad = F.array_compact(F.array(*[F.when(F.col(m).isNotNull() & F.col(f"__{m}").isNull(), F.lit(m)) for m in metrics]))
    named = F.trim(F.coalesce("product_name", F.lit(""))) != ""
    rows = parsed.where(named).select(*[F.col(f"__{c}").cast("long" if metrics[c] else "double").alias(c) if c in metrics else F.col(c) for c in raw.columns])
    warned = parsed.select("image", "source_row", F.explode(F.when(named, bad).otherwise(F.array(F.lit("product_name")))).alias("field"))
    return rows, warned


def without_named(rows: DataFrame, column: str, excluded: DataFrame) -> DataFrame:
    """Rows whose name, regardless of case, isn't excluded."""
    names = excluded.select(F.lower("clue").alias("__x")).distinct()
    return rows.join(names, F.lower(F.col(column)) == F.col("__x"), "left_anti")


def reconcile_expansions(roles: DataFrame, answers: DataFrame, most_terms: int = 6) -> DataFrame:
    """Roles (scene, product_cn, product_en) with their expansions; a role without exactly one sound answer falls back to its own names."""
    sound = (F.size("expanded_cn") <= most_terms) & (F.size("expanded_en") <= most_terms) & (F.trim("canonical_cn") != "") & (F.trim("canonical_en") != "")
    keys = ["scene", "product_cn", "product_en"]
    g = answers.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct("canonical_cn", "canonical_en", "expanded_cn", "expanded_en")).alias("a"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"))
    j = roles.join(g, keys, "left")
    used = F.coalesce((F.col("n") == 1) & F.col("sound"), F.lit(False))
    none = F.array().cast("array<string>")
    return j.select(
        *roles.columns, F.when(used, F.col("a.canonical_cn")).otherwise(F.col("product_cn")).alias("canonical_cn"), F.when(used, F.col("a.canonical_en")).otherwise(F.col("product_en")).alias("canonical_en"),
        F.when(used, F.col("a.expanded_cn")).otherwise(none).alias("expanded_cn"), F.when(used, F.col("a.expanded_en")).otherwise(none).alias("expanded_en"), used.alias("expanded"),
    )


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows carry the names of the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    j = rows.withColumn("broken", broken)
    return j.where(F.size("broken") == 0).drop("broken"), j.where(F.size("broken") > 0)


def frames_for(images: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames in the images' order; a picture without a frame or a frame without a picture is an error."""
    j = images.select("image", "image_place").join(frames, "image", "full_outer")
    one_sided = F.col("image_place").isNull() | F.col(frames.columns[-1]).isNull()
    return j.withColumn("image", F.when(one_sided, F.raise_error(F.concat(F.lit("images and frames differ: "), "image")).cast("string")).otherwise(F.col("image")))


def scene_frames(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Scenes with their products, none where no frame names the scene. frames: (scene, products)."""
    empty = frames.schema["products"].dataType.simpleString()
    return scenes.join(frames, "scene", "left").withColumn("products", F.coalesce("products", F.array().cast(empty)))
