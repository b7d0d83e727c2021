"""Operators on hand-computed cases, and BM25 against SQLite's own."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestock.functions import text as tx
from lodestock.operators import benchmark, catalog, clues, export, fusion, incremental, rerank, search, stock
from lodestock.sources import tables, xlsx

ROW = ", ".join(f"{c} string" for c in catalog.ROW_FIELDS)


def source(spark, *rows):
    full = [(i, *[r.get(c, "") for c in catalog.ROW_FIELDS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, f"ord long, {ROW}")


def test_family(spark):
    rows = source(
        spark,
        {"sku": "A-1", "main_sku": " A ", "product_name": "灯 A-1", "english_name": "Lamp", "english_keywords": "n/a", "category_level_1": "户外", "category_level_2": "灯"},
        {"sku": "A-2", "main_sku": "A", "product_name": "灯 链接拍", "english_name": "lamp", "category_level_1": "户外", "sales_status_raw": "Shopee 禁售"},
        {"sku": "X-1", "main_sku": "1a0000", "product_name": "废"},
    )
    docs = {r["main_sku"]: r for r in catalog.build_documents(rows).collect()}
    a = docs["A"]
    assert a["cn_names"] == ["灯", "灯 链接拍"] and a["leaf_categories"] == ["户外", "灯"]
    assert a["category_paths"] == [["户外", "灯"], ["户外"]] and a["vector_text_v1"] == "商品名称：灯"
    assert a["quality_flags"] == ["mixed_leaf_category", "operational_text", "placeholder_english"] and a["searchable"]
    assert [c["sku"] for c in a["children"]] == ["A-1", "A-2"]
    assert not docs["1a0000"]["searchable"] and docs["1a0000"]["children"][0]["status_flags"] == ["excluded_sku"]
    english = catalog.english_documents(catalog.build_documents(rows)).where("main_sku = 'A'").first()
    assert english["en_aliases"] == ["Lamp"] and english["vector_text_v1"] == "Product name: Lamp"
    eligible = fusion.eligible_children(catalog.build_documents(rows), F.lit("shopee")).where("main_sku = 'A'").first()
    assert eligible["eligible"] == ["A-1"]


def test_family_needs_ids(spark):
    with pytest.raises(Exception, match="non-empty sku"):
        catalog.build_documents(source(spark, {"sku": "", "main_sku": "A"})).collect()


def test_child_of_two_mains(spark):
    docs = catalog.build_documents(source(spark, {"sku": "c", "main_sku": "A"}, {"sku": "c", "main_sku": "B"}))
    with pytest.raises(Exception, match="multiple main"):
        catalog.child_map(docs, F.transform("children", lambda c: c["sku"])).collect()


def test_bm25_is_sqlite_s(spark):
    docs = [("A", "red lamp tent", "outdoor", "lamp lamp"), ("B", "tent", "indoor outdoor", "big red tent pole"), ("C", "chair", "indoor", "folding chair"), ("D", "lamp", "light", "light"), ("E", "stool", "x", "y")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(k unindexed, cn_names, categories, en_aliases)")
    con.executemany("insert into t values (?, ?, ?, ?)", docs)
    want = {r[0]: round(r[1], 9) for r in con.execute("select k, -bm25(t, 0, 8, 4, 1) from t where t match '\"red\" OR \"lamp\" OR \"outdoor\"'")}
    df = spark.createDataFrame(docs, "k string, cn_names string, categories string, en_aliases string")
    fields = {f: F.split(f, " ") for f in search.FIELD_WEIGHTS}
    asked = spark.createDataFrame([("q", t) for t in ("red", "lamp", "outdoor")], "query_id string, token string")
    got = search.keyword_search(search.postings(df, "k", fields), search.document_lengths(df, "k", fields), asked, 10)
    assert {r["doc"]: r["score"] for r in got.collect()} == want
    one = search.keyword_search(search.postings(df, "k", fields), search.document_lengths(df, "k", fields), asked, 10, weights={"en_aliases": 1.0})
    want = {r[0]: round(r[1], 9) for r in con.execute("select k, -bm25(t, 0, 0, 0, 1) from t where t match 'en_aliases : (\"red\" OR \"lamp\" OR \"outdoor\")'")}
    assert {r["doc"]: r["score"] for r in one.collect()} == want


def test_exact_vectors(spark):
    v = spark.createDataFrame([("B", [1.0, 0.0]), ("ZERO", [0.0, 0.0]), ("A", [1.0, 0.0]), ("NEG", [-1.0, 0.0])], "doc string, vector array<float>")
    q = spark.createDataFrame([(1, [4.0, 0.0])], "query_id int, vector array<float>")
    got = search.vector_search(v, q, 4, metric="unit").orderBy("rank").collect()
    assert [(r["doc"], r["score"]) for r in got] == [("A", 1.0), ("B", 1.0), ("ZERO", 0.5), ("NEG", 0.0)]
    assert [r["doc"] for r in search.vector_search(v, q, 1).collect()] == ["A"]


def test_fusion(spark):
    hits = [("r", "keyword", "q", 1.0, d, i) for i, d in enumerate("ABA", 1)] + [("r", "vector", "q", 1.0, d, i) for i, d in enumerate("CA", 1)]
    df = spark.createDataFrame(hits, "role_id string, channel string, query string, weight double, doc string, place int")
    got = {r["doc"]: (r["score"], r["rank"]) for r in fusion.fuse(df).collect()}
    assert got == {"A": (round(1 / 61 + 1 / 62, 12), 1), "C": (round(1 / 61, 12), 2), "B": (round(1 / 62, 12), 3)}


def test_stock(spark):
    rows = spark.createDataFrame([(2, "a", "A", "泰国", "1,000", "5"), (3, "a", "A", "TH", "-2000", ""), (4, "b", "A", "TH", "1", "0"), (5, "a", "A", "PH", "7", "0"), (6, "z", "Z", "TH", "1", "1")], "row int, child_sku string, main_sku string, country string, centre string, public_pool string")
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "child_sku string, main_sku string")
    main, child = stock.totals(stock.country_rows(rows, known, "泰国"))
    assert [tuple(r) for r in main.collect()] == [("A", -995.0)] and [tuple(r) for r in child.collect()] == [("a", 1005.0)]
    assert stock.conflict_note(stock.route_rows(rows, known)).first()["conflicts"] == 1
    c = spark.createDataFrame([("r", "A", 1), ("r", "B", 2)], "role_id string, main_sku string, rank int")
    a = stock.annotate(c, spark.createDataFrame([("A", -1.0), ("B", 2.0)], "main_sku string, quantity double"))
    assert {r["main_sku"]: (r["country_available"], r["country_available_quantity"]) for r in a.collect()} == {"A": (False, None), "B": (True, 2.0)}
    assert [r["country_available"] for r in stock.annotate(c, None).collect()] == [None, None]


def test_verdicts_and_their_undoing(spark):
    c = spark.createDataFrame([("s", "r", m, i, a) for i, (m, a) in enumerate([("A", True), ("B", None), ("C", False), ("D", True)], 1)], "scene string, role string, main_sku string, rank int, country_available boolean")
    v = spark.createDataFrame([("s", "A", "unrelated", 0.9), ("s", "B", "related", 0.1), ("s", "D", "unrelated", None)], "scene string, main_sku string, verdict string, probability double")
    kept, gone = rerank.apply_verdicts(c, v, cutoff=0.5, drop=True)
    assert [r["main_sku"] for r in kept.orderBy("rank").collect()] == ["B", "C", "D"] and [r["main_sku"] for r in gone.collect()] == ["A"]
    back = rerank.strip_verdicts(kept, gone)
    assert [r["main_sku"] for r in back.orderBy("rank").collect()] == list("ABCD")
    again = rerank.strip_verdicts(back.withColumn("recall_rank", F.lit(None).cast("int")).withColumn("rerank", F.lit(None).cast("string")), gone.limit(0))
    assert [r["main_sku"] for r in again.orderBy("rank").collect()] == list("ABCD")


def test_judgments_must_match(spark):
    hits = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, doc string, rank int")
    with pytest.raises(Exception, match="judgments must match"):
        rerank.soft_rerank(hits, spark.createDataFrame([(1, "A", 3)], "query_id int, doc string, level int")).collect()


def test_answers_of_a_bad_batch_are_refused(spark):
    asked = spark.createDataFrame([("s", 0, "A"), ("s", 0, "B"), ("s", 1, "C")], "scene string, batch long, main_sku string")
    said = spark.createDataFrame([("s", 0, "A", "related", 0.5), ("s", 0, "Z", "related", 0.5), ("s", 1, "C", "unrelated", 2.0)], "scene string, batch long, main_sku string, verdict string, probability double")
    assert [tuple(r) for r in rerank.read_answers(said, asked).collect()] == [("s", "C", "unrelated", None)]


def test_buy_list_and_children(spark):
    c = spark.createDataFrame([("s1", "r1", "A", 2, 0, 0, "灯", 5.0), ("s1", "r2", "A", 1, 0, 1, "灯", 5.0), ("s2", "r1", "B", 1, 1, 0, "桌", None)], "scene string, role string, main_sku string, rank int, scene_place int, role_place int, name string, quantity double")
    bought = {r["main_sku"]: r["uses"] for r in export.buy_list(c).collect()}
    assert bought == {"A": "s1 · r1\ns1 · r2", "B": "s2 · r1"}
    assert [(r["main_sku"], r["rank"]) for r in export.scene_blocks(c).where("scene = 's1'").collect()] == [("A", 1)]
    ch = spark.createDataFrame([("A", 0, "a1", "x"), ("A", 1, "a2", "y")], "main_sku string, place int, child_sku string, child_name string")
    rows = export.child_rows(export.buy_list(c), ch, spark.createDataFrame([("a2", 3.0)], "child_sku string, quantity double"))
    assert [(r["child_sku"], r["quantity"]) for r in rows.where("main_sku = 'A'").orderBy("line").collect()] == [("a2", "3.0"), ("a1", "0.0")]
    assert rows.where("main_sku = 'B'").first()["child_sku"] == export.NO_CHILD


def test_upsert_errors(spark):
    new = spark.createDataFrame([("a", "A", "h1", 0), ("a", "A", "h2", 1)], "sku string, main_sku string, row_hash string, ord int")
    with pytest.raises(Exception, match="conflicting duplicate"):
        incremental.distinct_children(new).collect()
    old = spark.createDataFrame([("a", "B", "h1")], "sku string, main_sku string, row_hash string")
    with pytest.raises(Exception, match="reparent"):
        incremental.compare_rows(new.limit(1), old).collect()


def test_reviewed_names_stay_reviewed(spark):
    queue = spark.createDataFrame([("A", "e1", "reviewed"), ("B", "e1", "reviewed")], "main_sku string, evidence_hash string, status string")
    now = spark.createDataFrame([("A", "e1"), ("B", "e2"), ("C", "e1")], "main_sku string, evidence_hash string")
    got = {r["main_sku"]: r["status"] for r in incremental.refresh_queue(queue, now, now.select("main_sku")).collect()}
    assert got == {"A": "reviewed", "B": "pending", "C": "pending"}


def test_clue_merge(spark):
    seen = spark.createDataFrame([("灯具、桌子", "1.png", 0, 0, clues.SCENERY, 0.9, "e1"), ("灯具", "2.png", 1, 0, clues.CARD, 0.5, "e2")], "name string, image string, image_place int, place int, role string, confidence double, evidence string")
    got = {r["clue"]: r for r in clues.merge_clues(seen).collect()}
    assert got["灯具"]["role"] == clues.CARD and got["灯具"]["images"] == ["1.png", "2.png"] and got["灯具"]["merged_from"] == ["灯具、桌子"]
    assert got["桌子"]["evidence"] == "e1"


def test_hit_rate(spark):
    items = spark.createDataFrame([("q1", ["A"], "has_match", "provisional"), ("q2", ["Z"], "has_match", "provisional"), ("q3", [], "no_match", "provisional")], "query_id string, relevant array<string>, expected_status string, label_status string")
    res = spark.createDataFrame([("q1", d, i) for i, d in enumerate("BBBBA", 1)] + [("q2", d, i) for i, d in enumerate("ABCDEZ", 1)], "query_id string, doc string, place int")
    r = benchmark.hit_rate(benchmark.hits(items, res)).first()
    assert (r["queries"], r["hits"], r["hit_rate"], r["enforced"], r["passed"]) == (2, 1, 0.5, False, True)


def test_workbook(spark, tmp_path):
    head = [*tables.SOURCE_HEADERS, "额外列"]
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_workbook([("other", ["x"], [[1]]), ("one", head, [["A-1", "A", "灯", None, 1.5, "", 3], [None] * 3]), ("two", head, [["B-1", "B"]])]))
    rows = tables.source_rows(spark, f"file://{tmp_path}/a.xlsx").orderBy("ord").collect()
    assert [(r["sheet"], r["row"], r["sku"], r["english_keywords"], r["category_level_4"]) for r in rows] == [("one", 2, "A-1", "1.5", ""), ("two", 2, "B-1", "", "")]
    with pytest.raises(Exception, match="no sheet"):
        tables.source_rows(spark, f"file://{tmp_path}/a.xlsx", sheet="other").collect()


def test_stock_snapshot(spark, tmp_path):
    sheet = (tables.STOCK_SHEET, ["商品图片", "子SKU", "主SKU", "国家", "海外仓可发", "销售员"], [["汇总"], [None, "A-1", "A", "菲律宾", 5, "x"], [None, "A-1", "A", "菲律宾", 5, "y"], [None, "A-2", "A", "泰国", 0, "x"], [None, "B-1", "B", "泰国", "2", "x"]])
    (tmp_path / "s.xlsx").write_bytes(xlsx.write_workbook([sheet]))
    got = stock.availability(tables.snapshot_rows(spark, f"file://{tmp_path}/s.xlsx"))
    assert {r["country"]: r["mains"] for r in got.collect()} == {"PH": ["A"], "TH": ["B"]}


def test_folded_tokens(spark):
    df = spark.createDataFrame([("Éoution T恤 x_y",)], "t string")
    assert df.select(tx.index_words(tx.fold_accents(F.col("t")))).first()[0] == ["eoution", "t恤", "x", "y"]
