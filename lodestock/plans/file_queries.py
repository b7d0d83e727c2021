"""Scans of files: each query writes the files of a table to the shared folder, reads them through the engine's scan, and has the table's SQL."""

from __future__ import annotations

import io
import json
import uuid
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import functions as F

from ..operators import runs, stock
from ..sources import tables, xlsx
from ..sources.store import shared_folder
from ..streaming import upsert
from .change_queries import put_file
from .registry import query, table


class Part(NamedTuple):
    p_partkey: int
    p_brand: str
    p_type: str
    p_size: int


def folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def workbooks(spark, sf_dir: str, sheets):
    """Parts as workbooks, written by the tasks that read them and kept as a table (path, content). sheets: of parts (p_partkey, p_brand, p_type, p_size)."""
    path = f"{folder(spark)}/workbooks.parquet"
    xlsx.workbooks(table(spark, sf_dir, "part").select(*Part._fields), lambda rows: sheets([Part(*r) for r in rows])).write.parquet(path)
    return spark.read.parquet(path)


@query("""select 'C' || p_partkey as child_sku, p_brand as main_sku, case when p_size % 2 = 0 then 'PH' else 'TH' end as country, cast(p_size as double) as quantity from part""")
def snapshot_workbook(spark, sf_dir):
    """A stock snapshot with total rows, which are no stock."""
    row = lambda p: [f" C{p.p_partkey}", p.p_brand, "PH" if p.p_size % 2 == 0 else "泰国", p.p_size]
    sheets = lambda parts: [(tables.STOCK_SHEET, list(tables.SNAPSHOT_HEADERS), chain(map(row, parts), [["", tables.TOTAL_ROW, "", 999]])), ("notes", ["x"], [["y"]])]
    return tables.snapshot_rows(spark, workbooks(spark, sf_dir, sheets)).select("child_sku", "main_sku", "country", "quantity")


@query("""select p_brand as main_sku, 'C' || p_partkey as child_sku, p_size * 1000.0::double as quantity from part where p_size % 7 <> 0 and p_type <> 'PROMO' and p_size % 2 = 0""")
def stock_workbook(spark, sf_dir):
    """One country's stock: children of another main than the catalog's and unknown ones (promotions) don't count; numbers have separators."""
    row = lambda p: [f"C{p.p_partkey}", "other" if p.p_size % 7 == 0 else p.p_brand, "ph" if p.p_size % 2 == 0 else "VN", f"{p.p_size},000", None]
    path = workbooks(spark, sf_dir, lambda parts: [(tables.STOCK_SHEET, list(tables.STOCK_HEADERS), map(row, parts))])
    known = table(spark, sf_dir, "part").where("p_type <> 'PROMO'").select(F.concat(F.lit("C"), "p_partkey").alias("child_sku"), F.col("p_brand").alias("main_sku"))
    return stock.country_rows(tables.stock_rows(spark, path), known, "菲律宾")


@query("""with m as (select 'PH' as country, p_brand as main_sku, sum(p_size)::double as centre, (count(*) filter (p_type <> 'PROMO'))::double as public_pool, count(*) * 1.0::double as n from part group by p_brand)
select country, main_sku, centre, public_pool, 2 * n as single_sale, 3 * n as local_transit, 4 * n as local_stock, 5 * n as overseas_transit, centre + public_pool as available, centre + public_pool + 12 * n as total from m""")
def measure_workbook(spark, sf_dir):
    """Two sheets whose headers stand below notes, and one that doesn't match; what is no number counts as 0."""
    line = lambda p: [f"C{p.p_partkey}", p.p_brand, "PH", p.p_size, "many" if p.p_type == "PROMO" else 1, 2, 3, 4, 5]
    sheet = lambda name, some: (name, ["note"], chain([["", "more"], list(tables.MEASURE_HEADERS)], map(line, some)))
    path = workbooks(spark, sf_dir, lambda parts: [sheet("small", [p for p in parts if p.p_size <= 25]), ("notes", ["x"], [["y"]]), sheet("large", [p for p in parts if p.p_size > 25])])
    return stock.measures(tables.measure_rows(spark, path))


@query("""select cast(item_id as varchar) as query_id, text as query, 'b' || item_id as relevant, 'has_match' as expected_status from benchmark""")
def benchmark_file(spark, sf_dir):
    items = [
        {"query_id": str(r.item_id), "query": r.text, "relevant_main_skus": [f"b{r.item_id}"], "expected_status": "has_match", "label_status": "provisional", "notes": ""}
        for r in table(spark, sf_dir, "benchmark").toLocalIterator()
    ]
    path = f"{folder(spark)}/benchmark.json"
    put_file(spark, path, json.dumps(items, ensure_ascii=False).encode())
    return tables.benchmark_items(spark, path).select("query_id", "query", F.array_join("relevant_main_skus", ",").alias("relevant"), "expected_status")


@query("""select r_name as scene, n_name as product_cn, lower(n_name) as canonical_en, n_name || '|x' as expanded_cn from nation join region on n_regionkey = r_regionkey""")
def expansion_file(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).toLocalIterator()
    scenes = [
        {"scene_name": x.r_name, "product_cn": x.n_name, "product_en": "e", "canonical_cn": x.n_name, "canonical_en": x.n_name.lower(), "expanded_cn": [x.n_name, "x"], "expanded_en": []}
        for x in rows
    ]
    path = f"{folder(spark)}/expansions.json"
    put_file(spark, path, json.dumps({"schema": "expansions-v1", "scenes": scenes}, ensure_ascii=False).encode())
    found = tables.json_documents(spark, path, tables.EXPANSIONS, tag="expansions-v1").select("schema", F.explode("scenes").alias("s")).where("schema is not null")
    return found.select(F.col("s.scene_name").alias("scene"), "s.product_cn", "s.canonical_en", F.array_join("s.expanded_cn", "|").alias("expanded_cn"))


@query("""select 'v' || vec_id as main_sku, cast(len(embedding) as integer) as size, cast(embedding[1] as double) as first_value, cast(embedding[len(embedding)] as double) as last_value from embeddings""")
def vector_files(spark, sf_dir):
    """A matrix file and the file of its rows' ids."""
    ids, rows = [], []
    for r in table(spark, sf_dir, "embeddings").toLocalIterator():
        ids.append(f"v{r.vec_id}")
        rows.append(np.array(r.embedding, np.float32))
    out, where = io.BytesIO(), folder(spark)
    np.save(out, np.stack(rows))
    put_file(spark, f"{where}/matrix.npy", out.getvalue())
    put_file(spark, f"{where}/rows.json", json.dumps(ids).encode())
    v = tables.vector_matrix(spark, f"{where}/matrix.npy", f"{where}/rows.json")
    return v.select("main_sku", F.size("vector").alias("size"), F.col("vector")[0].cast("double").alias("first_value"), F.element_at("vector", -1).cast("double").alias("last_value"))


@query("""select n_name || '.png' as name, to_base64(encode(repeat(n_name, 9))) as base64, sha256(repeat(n_name, 9)) as sha256, cast(length(n_name) * 9 as integer) as bytes, true as listed from nation""")
def picture_files(spark, sf_dir):
    """Files as base64 and as a listing; both scans see the same bytes."""
    where = folder(spark)
    for r in table(spark, sf_dir, "nation").toLocalIterator():
        put_file(spark, f"{where}/{r.n_name}.png", (r.n_name * 9).encode())
    listing = tables.store_listing(spark, f"{where}/*.png").select("path", "bytes", F.col("sha256").alias("listed_sha256"))
    both = tables.pictures(spark, f"{where}/*.png").join(listing, ["path", "bytes"])
    return both.select(F.element_at(F.split("path", "/"), -1).alias("name"), "base64", "sha256", F.col("bytes").cast("int").alias("bytes"), (F.col("sha256") == F.col("listed_sha256")).alias("listed"))


@query("""select 'first' as source, p_brand as main_sku, cast(count(*) as bigint) as rows from part group by p_brand union all select 'second', p_type, cast(count(*) as bigint) from part group by p_type""")
def import_audit(spark, sf_dir):
    """Two imports' records, the second added to the first."""
    path = f"{folder(spark)}/audit"
    p = table(spark, sf_dir, "part")
    for source, column in (("first", "p_brand"), ("second", "p_type")):
        runs.append_audit(p.groupBy(F.col(column).alias("main_sku")).agg(F.count("*").alias("rows")).select(F.lit(source).alias("source"), "main_sku", "rows"), path)
    return spark.read.parquet(path)


@query("""select event_id, event_type, value from events""")
def streaming_snapshot(spark, sf_dir):
    """A stream whose files replace the table; what is left is the last file."""
    where, source = folder(spark), f"{sf_dir}/events.parquet"
    done = upsert.replace_snapshot(spark, upsert.glob_of(source), where, spark.read.parquet(source).schema, by="event_type")
    return spark.read.parquet(f"{where}/snapshot-{done[-1] % 2}").select("event_id", "event_type", "value")
