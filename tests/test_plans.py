"""Whole searches, parameters, stages, providers and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestock import cli
from lodestock.functions.embedding import HashingProvider, embed, embed_cached
from lodestock.operators import runs
from lodestock.plans import retrieval, stages
from lodestock.plans.params import SearchParams
from lodestock.sources import tables, xlsx
from lodestock.streaming.upsert import stream_upsert


def test_four_channels(spark):
    products = spark.createDataFrame([("A", "露营折叠椅", "Camping Chair"), ("B", "户外折叠桌", "Outdoor Folding Table"), ("C", "灯", "Lamp")], "main_sku string, standard_name_cn string, standard_name_en string")
    make = HashingProvider
    both = products.select("main_sku", F.explode(F.create_map(F.lit("cn"), "standard_name_cn", F.lit("en"), "standard_name_en")).alias("language", "text"))
    vectors = embed(both, "text", make).select("language", "main_sku", "vector")
    roles = spark.createDataFrame([("s/椅", "折叠椅", "chair", "折叠椅", "camping chair", [], ["folding chair"])], "role_id string, product_cn string, product_en string, canonical_cn string, canonical_en string, expanded_cn array<string>, expanded_en array<string>")
    terms = spark.createDataFrame([("cn", "折叠椅"), ("en", "chair"), ("en", "camping chair"), ("en", "folding chair")], "language string, query string")
    kept, status = retrieval.retrieve(roles, products, vectors, embed(terms, "query", make), spark.createDataFrame([("A", 3.0)], "main_sku string, quantity double"), SearchParams(recall_limit=5))
    rows = kept.orderBy("rank").collect()
    assert rows[0]["main_sku"] == "A" and rows[0]["channels"] == ["cn_keyword", "cn_vector", "en_keyword", "en_vector"] and rows[0]["country_available"]
    assert status.first()["match_status"] == "matched"
    none, status = retrieval.retrieve(roles, products, vectors, embed(terms, "query", make), spark.createDataFrame([], "main_sku string, quantity double"), SearchParams(stock_filter="in_stock"))
    assert none.count() == 0 and status.first()["match_status"] == "no_stock_in_recalled_candidates"
    with pytest.raises(RuntimeError):
        retrieval.retrieve(roles, products, vectors, terms, None, SearchParams(stock_filter="in_stock"))


def test_cached_vectors(spark):
    rows = spark.createDataFrame([(1, "a lamp"), (2, "a lamp"), (3, "tent")], "id int, t string")
    done, new = embed_cached(rows, "t", HashingProvider, "m", None)
    assert done.count() == 3 and new.count() == 2
    done, newer = embed_cached(rows, "t", HashingProvider, "m", new)
    assert done.count() == 3 and newer.count() == 0


def test_params():
    assert SearchParams.settled({"scene_count": 99, "stock_filter": "x", "recall_limit": 1, "old": 1}) == SearchParams(scene_count=8, recall_limit=5)
    with pytest.raises(ValueError):
        SearchParams(temperature=2)
    assert len(SearchParams.schema()) == 7


def behind(spark, *, files=None, missing=(), recorded=(), settings=(), pictures=(), read=(), unfinished=()):
    names = ["sample_store.json", "clues.json", "analysis_input.json", "deepseek_conclusion.json", "deepseek_scenes.json", "products/manifest.json", "expansions.json", "retrieval.json", "rerank.json"]
    times = {n: i for i, n in enumerate(names) if n not in missing} | (files or {})
    frame = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    unread = runs.unread_pictures(frame([("s", p) for p in pictures], "store string, picture string"), frame([("s", p) for p in read], "store string, picture string"))
    noted = stages.settings_read(frame([("s", *r) for r in recorded], "store string, stage string, key string, value string"))
    out = runs.stale_stages(
        stages.stage_table(spark), frame([("s",)], "store string"), frame([("s", n, t) for n, t in times.items()], "store string, name string, modified int"),
        frame([("s", g) for g in stages.ORDER if g not in unfinished], "store string, stage string"), noted, frame([("s", *r) for r in settings], "store string, key string, value string"), unread,
    )
    return [r["stage"] for r in out.where("behind").orderBy("place").collect()]


def test_stale_stages(spark):
    assert behind(spark) == []
    assert behind(spark, recorded=[("retrieval", "recall_limit", "1"), ("retrieval", "temperature", "9")], settings=[("recall_limit", "2")]) == ["retrieval", "rerank"]
    assert behind(spark, files={"analysis_input.json": 99})[0] == "synthesis"
    assert behind(spark, pictures=["a", "b"], read=["a", "b"]) == [] and behind(spark, pictures=["a", "b"], read=["a"]) == list(stages.ORDER)
    assert behind(spark, missing=["sample_store.json"])[0] == "recognize" and behind(spark, unfinished=["expand"]) == ["expand", "retrieval", "rerank"]


def test_vector_matrix(spark, tmp_path):
    def read(m, ids):
        np.save(tmp_path / "m.npy", m)
        (tmp_path / "r.json").write_text(json.dumps(ids))
        return [(r["main_sku"], r["vector"]) for r in tables.vector_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "r.json")).collect()]

    m = np.array([[1, 2], [3, 4]], np.float32)
    assert read(m, ["a", "b"]) == [("a", [1, 2]), ("b", [3, 4])]
    for bad, ids in ((m.astype(float), ["a", "b"]), (m, ["a", "a"]), (m, ["a"]), (m * np.nan, ["a", "b"]), (m[0], ["a", "b"]), (m, ["a", ""])):
        with pytest.raises(Exception, match="vector"):
            read(bad, ids)


def test_scenes_named_twice_and_views(spark):
    wanted = spark.createDataFrame([("s", "x", "1"), ("s", "x", "1")], "store string, scene string, request string")
    with pytest.raises(Exception, match="named twice"):
        runs.unfinished(wanted, spark.createDataFrame([], "store string, scene string, request string, recorded string, found string")).collect()
    with pytest.raises(ValueError):
        runs.visible(wanted, "none")


def test_audit(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, report string")
    for _ in range(2):
        runs.append_audit(rows, f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 2


def test_stages():
    assert stages.chosen(("rerank", "clues")) == ("clues", "rerank")
    with pytest.raises(ValueError):
        stages.chosen(("x",))
    a = stages.IndexState("v", 1, "m", 4, "p", ("PH",))
    with pytest.raises(ValueError):
        a.stock_only(a, 1, 0, False)
    with pytest.raises(ValueError):
        a.check_countries(("TH",))


def test_command_line(spark, tmp_path, capsys):
    head = list(tables.SOURCE_HEADERS)
    row = lambda sku, main, cn, en, status="": [sku, main, cn, en, "", status, "目录", "户外", "", "", ""]
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_workbook([("s", head, [row("A-1", "A", "露营折叠椅", "Camping chair"), row("B-1", "B", "户外折叠桌", "Folding table", "Shopee 禁售"), row("Z", "", "无主", "none")])]))
    (tmp_path / "b.xlsx").write_bytes(xlsx.write_workbook([("s", head, [row("A-2", "A", "露营椅 新", "New chair"), row("C-1", "C", "灯", "Lamp")])]))
    run = lambda *a: (cli.main(["--index-root", str(tmp_path / "idx"), *a], spark), capsys.readouterr().out)[1]
    assert json.loads(run("rebuild", "--source", str(tmp_path / "a.xlsx")))["unassigned_rows"] == 1
    assert json.loads(run("search", "--query", "折叠椅").splitlines()[0])["main_sku"] == "A"
    assert {json.loads(x)["main_sku"] for x in run("search", "--query", "folding chair", "--platform", "Shopee").splitlines()} == {"A"}
    assert json.loads(run("update", "--source", str(tmp_path / "b.xlsx")))["new_mains"] == 1
    run("update", "--source", str(tmp_path / "b.xlsx"), "--apply")
    assert json.loads(run("search", "--query", "lamp").splitlines()[0])["main_sku"] == "C"
    run("rollback")
    assert run("search", "--query", "lamp") == ""
    assert json.loads(run("status"))["manifest"]["counts"]["documents"] == 2


def test_stream_keeps_the_last_row_of_a_key(spark, tmp_path):
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(3, 1, "d"), (1, 1, "late")]]):
        spark.createDataFrame(rows, "k long, t long, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3):
        part = next((tmp_path / "in" / str(i)).glob("part-*"))
        part.rename(flat / f"{i}.parquet")
    got = stream_upsert(spark, f"file://{flat}/", f"file://{tmp_path}", key="k", order="t")
    assert {r["k"] for r in got.collect()} == {1, 2, 3}


@pytest.mark.parametrize("most", [1_000_000, 300, 1])
def test_workbook_holds_every_part(spark, monkeypatch, most):
    from lodestock.plans import change_queries
    from lodestock.plans.catalog_queries import part_rows

    paged, sf = xlsx.paged, "/root/testdata/sf0.01" if most > 1 else "/root/testdata/sf0.001"
    monkeypatch.setattr(xlsx, "paged", lambda *a: paged(*a, most_rows=most))
    got = change_queries.xlsx_roundtrip(spark, sf)
    want = part_rows(spark, sf).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 200


def test_paged_sheets():
    pages = lambda n: [(name, list(rows)) for name, _, rows in xlsx.paged("p", ["h"], ([i] for i in range(n)), most_rows=2)]
    assert pages(0) == [("p", [])] and pages(2) == [("p", [[0], [1]])]
    assert pages(5) == [("p", [[0], [1]]), ("p 2", [[2], [3]]), ("p 3", [[4]])]


def test_workbooks_are_written_by_tasks(spark, sf):
    """Several workbooks of a task's rows come back as the rows; no query of workbooks iterates over parts on the driver."""
    import inspect

    from lodestock.plans import change_queries, file_queries
    from lodestock.sources import xlsx

    rows = spark.range(25).selectExpr("id", "concat('n', id) as name").coalesce(2)
    books = xlsx.workbooks(rows, lambda some: [("notes", ["x"], [["y"]]), ("rows", ["id", "name"], some)], most_rows=4).cache()
    assert books.count() >= 7
    got = xlsx.columns(xlsx.read_tables(spark, books, ("id", "name")), {"id": "id", "name": "name"})
    assert sorted((int(r.id), r.name) for r in got.select("id", "name").collect()) == [(i, f"n{i}") for i in range(25)]
    for f in (change_queries.xlsx_roundtrip, file_queries.measure_workbook, file_queries.snapshot_workbook, file_queries.stock_workbook):
        assert "toLocalIterator" not in inspect.getsource(f) + inspect.getsource(file_queries.workbooks) and "parts(spark" not in inspect.getsource(f)
