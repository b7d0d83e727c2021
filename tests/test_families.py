"""Flat families against nested documents, and a family of very many children."""

from pyspark.sql import functions as F

from lodestock.operators import catalog, export, fusion, incremental, quality


def source(spark, n, main):
    ids = spark.range(n)
    text = lambda *parts: F.concat_ws(" ", *parts)
    blank = F.lit("")
    return ids.select(
        F.col("id").alias("ord"), F.concat(F.lit("c"), "id").alias("sku"), main.alias("main_sku"), F.when(F.col("id") % 17 == 0, "N/A").otherwise(text(F.lit("lamp"), F.col("id") % 23, F.concat(F.lit("c"), "id"))).alias("product_name"),
        F.when(F.col("id") % 5 == 0, "Lamp").when(F.col("id") % 5 == 1, "LAMP").otherwise(text(F.lit("light"), F.col("id") % 3)).alias("english_name"), F.when(F.col("id") % 31 == 0, "none").otherwise("").alias("english_keywords"),
        F.when(F.col("id") % 7 == 0, "Shopee banned").otherwise("").alias("sales_status_raw"), F.lit("all").alias("product_catalog"), text(F.lit("level"), F.col("id") % 4).alias("category_level_1"),
        F.when(F.col("id") % 2 == 0, "Deep").otherwise("").alias("category_level_2"), blank.alias("category_level_3"), blank.alias("category_level_4"),
    )


def test_flat_tables_say_what_documents_say(spark):
    rows = source(spark, 400, F.concat(F.lit("m"), F.col("id") % 9))
    out = spark.createDataFrame([("c3",), ("c8",)], "sku string")
    docs = {r["main_sku"]: r for r in catalog.build_documents(rows, out).collect()}
    entries = catalog.family_entries(rows, out).cache()
    facts = {r["main_sku"]: r for r in catalog.family_facts(entries).collect()}
    assert {m: (d["searchable"], d["vector_text_v1"], d["quality_flags"], len(d["children"])) for m, d in docs.items()} == {m: (f["searchable"], f["vector_text_v1"], f["quality_flags"], f["children"]) for m, f in facts.items()}
    for kind, column in (("cn", "cn_names"), ("en", "en_aliases"), ("leaf", "leaf_categories")):
        names = catalog.family_names(entries).where(F.col("kind") == kind).orderBy("main_sku", "place").collect()
        assert {m: d[column] for m, d in docs.items()} == {m: [n["name"] for n in names if n["main_sku"] == m] for m in docs}
    flat = catalog.family_children(entries).orderBy("main_sku", "place").collect()
    assert {m: d["children"] for m, d in docs.items()} == {m: [type(docs[m]["children"][0])(**{k: c[k] for k in ("sku", "display_name", "sales_status_raw", "status_flags")}) for c in flat if c["main_sku"] == m] for m in docs}
    assert docs["m3"]["quality_flags"][0] == "excluded_children" and docs["m0"]["category_paths"][0] == ["level 0", "Deep"]


def test_one_family_of_very_many(spark):
    n = 200_000
    entries = catalog.family_entries(source(spark, n, F.lit("ONE")), ascii_only=True)
    fact = catalog.family_facts(entries).first()
    assert fact["children"] == n and fact["vector_text_v1"].count("；") == 7 and "mixed_leaf_category" in fact["quality_flags"]
    assert catalog.family_children(entries).agg(F.max("place"), F.countDistinct("sku")).first()[:] == (n - 1, n)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(sku" not in plan and "partial_min(show" in plan


def test_heads_say_what_documents_say(spark):
    """Names, English aliases with identifiers in them, meanings, representative names and sellable children: flat tables against nested documents."""
    rows = source(spark, 300, F.concat(F.lit("m"), F.col("id") % 7)).withColumn("english_name", F.when(F.col("ord") % 6 == 0, F.concat_ws(" ", "english_name", "sku")).when(F.col("ord") % 6 == 1, "m1").otherwise(F.col("english_name")))
    out = spark.createDataFrame([("c3",), ("c8",)], "sku string")
    docs, entries = catalog.build_documents(rows, out).cache(), catalog.family_entries(rows, out).cache()
    both = lambda a, b: (sorted(map(repr, a.collect())), sorted(map(repr, b.collect())))
    flat, nested = both(catalog.family_heads(entries), docs.withColumn("children", F.size("children").cast("long")))
    assert flat == nested
    flat, nested = both(catalog.english_heads(entries), catalog.english_documents(docs).withColumn("children", F.size("children").cast("long")))
    assert flat == nested
    flat, nested = both(catalog.representative_names(entries), catalog.representative_name(docs))
    assert flat == nested
    flat, nested = both(quality.document_metrics(catalog.family_heads(entries)), quality.document_metrics(docs))
    assert flat == nested
    live = fusion.eligible_rows(catalog.family_children(entries), F.lit("shopee"))
    flat, nested = both(export.joined(live, ["main_sku"], "place", "sku", ",", run=3), fusion.eligible_children(docs, F.lit("shopee")).select("main_sku", F.array_join("eligible", ",").alias("joined")))
    assert flat == nested


def test_merged_children_as_rows(spark):
    """Rows against merge_documents, with new, known and absent children and families; and a family whose pairs would be two billion."""
    old = source(spark, 200, F.concat(F.lit("m"), F.col("id") % 9)).where("ord % 3 <> 0")
    new = source(spark, 200, F.concat(F.lit("m"), F.col("id") % 9)).where("ord % 2 = 0 and main_sku <> 'm4'").withColumn("product_name", F.lit("other lamp")).withColumn("ord", -F.col("ord"))
    m = incremental.merge_documents(catalog.build_documents(old.where("main_sku <> 'm5'")), catalog.build_documents(new))
    nested = m.select("main_sku", F.posexplode("children").alias("place", "c")).select("main_sku", "place", "c.*")
    flat = incremental.merge_children(*[catalog.family_children(catalog.family_entries(d)) for d in (old.where("main_sku <> 'm5'"), new)])
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, nested.collect()))
    n = 60_000
    c = spark.range(n).select(F.lit("ONE").alias("main_sku"), F.col("id").cast("int").alias("place"), F.concat(F.lit("c"), "id").alias("sku"), F.lit("lamp").alias("display_name"), F.lit("").alias("sales_status_raw"), F.array().cast("array<string>").alias("status_flags"))
    merged = incremental.merge_children(c.where("place % 10 <> 0"), c.where("place % 4 = 0").withColumn("display_name", F.lit("lamp new")))
    assert merged.agg(F.count("*"), F.count_if(F.col("display_name") == "lamp new"), F.max("place")).first()[:] == (n - n // 20, n // 4, n - n // 20 - 1)


def test_brands_that_say_the_same_are_no_collisions(spark, tmp_path):
    """In larger tables every brand has every name and type; quality_metrics' SQL has regions alone collide."""
    from lodestock import plans

    names = spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 2).alias("p_brand"), F.lit("PROMO").alias("p_type"), F.lit(9).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    names.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).select(F.col("id").cast("int").alias("r_regionkey"), F.lit("r").alias("r_name")).write.parquet(f"{tmp_path}/region.parquet")
    got = plans.QUERIES["quality_metrics"](spark, str(tmp_path)).first()
    assert (got["document_count"], got["exact_document_collision_count"], got["mixed_category_document_count"]) == (5, 2, 0)
