"""The pipeline against a plain version of its stages."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestock.llm import quality

from .test_llm_operators import brute_components, brute_lines, check_packed


def test_stages(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = cp.quality(spark, docs, sf)
    assert one.columns == list(cp.COLUMNS) and {r["doc_id"] for r in one.collect()} == {i for i, k in verdict.items() if k}
    rows = {i: t for i, t in rows.items() if verdict[i]}
    gone = brute_lines(list(rows.items()))
    left = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows.items()}
    left = {i: t for i, t in left.items() if t.split() or not any(g[0] == i for g in gone)}
    two = cp.lines(spark, one, sf)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == {i: (t, len(t)) for i, t in left.items()}
    groups = brute_components(list(left.items()), 5, 80)
    three = cp.near_duplicates(spark, two, sf)
    assert {r["doc_id"] for r in three.collect()} == {i for i, (_, root) in groups.items() if root == i}
    four = cp.mixing(spark, three, sf)
    assert four.columns == list(cp.COLUMNS) and four.select("doc_id").distinct().join(three, "doc_id").count() == four.select("doc_id").distinct().count()
    counts = Counter(r["doc_id"] for r in four.collect())
    once = four.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    check_packed(cp.packing(spark, once, sf).collect(), texts, 2048)
    whole = cp.run(spark, sf)
    assert {r["doc_id"]: r["n"] for r in whole.where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == counts


def test_empty_and_null_tables(spark, tmp_path):
    """A pipeline over no rows, and over rows without texts, ends with what the last stage gives for them."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("null", [(i, None, None, None, None) for i in range(3)] + [(None, None, None, None, None), (4, " \n", "en", "s", 2)])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert cp.run(spark, folder).count() == 0  # texts of fewer than fifty words are rejected by the base rules
