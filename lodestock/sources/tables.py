"""Scans: source rows, stock, products, embeddings and JSON documents, each with its checks."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import xlsx

# Headers of the source workbook and of the stock workbooks, by column.
SOURCE_HEADERS = {
    "sku": "sku", "主SKU": "main_sku", "商品名称": "product_name", "英文名称": "english_name", "英文关键字": "english_keywords", "销售状态": "sales_status_raw", "商品目录": "product_catalog",
    "商品一级目录": "category_level_1", "商品二级目录": "category_level_2", "商品三级目录": "category_level_3", "商品四级目录": "category_level_4",
}
SNAPSHOT_HEADERS = {"子SKU": "child_sku", "主SKU": "main_sku", "国家": "country", "海外仓可发": "quantity"}
STOCK_HEADERS = {"子SKU": "child_sku", "主SKU": "main_sku", "国家": "country", "库存中心库存": "centre", "公共池库存": "public_pool"}
MEASURE_HEADERS = STOCK_HEADERS | {"单销": "single_sale", "本地海外仓在途": "local_transit", "本地海外仓库存": "local_stock", "海外仓在途": "overseas_transit"}
STOCK_SHEET, TOTAL_ROW = "汇总表格", "汇总"
EXPANSIONS = "schema string, scenes array<struct<scene_name:string,product_cn:string,product_en:string,canonical_cn:string,canonical_en:string,expanded_cn:array<string>,expanded_en:array<string>>>"
BENCHMARK = "query_id string, query string, relevant_main_skus array<string>, expected_status string, label_status string, notes string"


def source_rows(spark: SparkSession, path: str | DataFrame, sheet: str | None = None) -> DataFrame:
    """Source rows of a workbook: all its matching sheets, or the one named."""
    return xlsx.columns(xlsx.read_tables(spark, path, tuple(SOURCE_HEADERS), sheet=sheet), SOURCE_HEADERS)


def snapshot_rows(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rows of a stock snapshot less its total row, quantity as a number; a row without a child SKU or of an unknown country is an error."""
    from ..functions import text as tx

    raw = xlsx.read_tables(spark, path, tuple(SNAPSHOT_HEADERS), sheet=STOCK_SHEET)
    total = (F.trim(F.try_element_at("cells", F.lit("子SKU"))) == "") & F.exists(F.map_values("cells"), lambda v: F.trim(v) == TOTAL_ROW)
    rows = xlsx.columns(raw.where(~total), SNAPSHOT_HEADERS)
    where = F.concat(F.lit("stock row "), F.col("row").cast("string"))
    code = F.when(F.trim("child_sku") == "", F.raise_error(F.concat(where, F.lit(": missing child SKU"))).cast("string")).otherwise(F.coalesce(tx.country_code(F.col("country")), F.raise_error(F.concat(where, F.lit(": unknown country"))).cast("string")))
    return rows.select("row", F.trim("child_sku").alias("child_sku"), F.trim("main_sku").alias("main_sku"), code.alias("country"), tx.number(F.col("quantity"), strict=True).alias("quantity"))


def stock_rows(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    rows = xlsx.columns(xlsx.read_tables(spark, path, tuple(STOCK_HEADERS), sheet=STOCK_SHEET), STOCK_HEADERS)
    return rows.select("row", *[F.trim(c).alias(c) for c in STOCK_HEADERS.values()])


def measure_rows(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Rows of every sheet that has the headers within its first thirty rows, measures as numbers, what is none as 0."""
    from ..functions import text as tx

    rows = xlsx.columns(xlsx.read_tables(spark, path, tuple(MEASURE_HEADERS), header_rows=30), MEASURE_HEADERS)
    text = ("child_sku", "main_sku", "country")
    return rows.select("row", *[F.trim(c).alias(c) for c in text], *[tx.number(F.col(c)).alias(c) for c in MEASURE_HEADERS.values() if c not in text])


def products(table: DataFrame) -> DataFrame:
    """Active, indexable products; one without both names is an error. The filter reaches the scan."""
    live = table.where((F.col("active") == 1) & (F.col("indexable") == 1))
    blank = (F.trim("standard_name_cn") == "") | (F.trim("standard_name_en") == "")
    sku = F.when(F.coalesce(blank, F.lit(True)), F.raise_error(F.concat(F.lit("product without both names: "), "main_sku")).cast("string")).otherwise(F.col("main_sku"))
    return live.withColumn("main_sku", sku)


def product_children(table: DataFrame, *, strict: bool = False) -> DataFrame:
    """(main_sku, place, child_sku, child_name), the names from the evidence, "" where there is none."""
    names = sc.child_names(F.col("raw_evidence_json"))
    flat = table.select("main_sku", names.alias("names"), F.posexplode(sc.child_list(F.col("inventory_metadata_json"), strict=strict)).alias("place", "child_sku"))
    first = F.get(F.filter("names", lambda n: n["child_sku"] == F.col("child_sku")), F.lit(0))["name"]
    return flat.select("main_sku", "place", "child_sku", F.coalesce(first, F.lit("")).alias("child_name"))


def embeddings(table: DataFrame, dimension: int) -> DataFrame:
    """The table, an error where a vector has another size or a value that is not finite."""
    ok = sc.valid_vector(F.col("vector"), dimension)
    return table.withColumn("vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("bad vector: "), F.col("main_sku").cast("string"))).cast(table.schema["vector"].dataType)))


def json_documents(spark: SparkSession, path: str, schema: str, tag: str | None = None) -> DataFrame:
    """Whole-file JSON documents of one schema; another schema tag is an error."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if tag is None:
        return df
    return df.withColumn("schema", F.when(F.col("schema") == tag, F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("unexpected schema: "), F.coalesce("schema", F.lit("none")))).cast("string")))


def benchmark_items(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items; an unknown status, a blank query, an answer without SKUs or a repeated id is an error."""
    df = spark.read.schema(BENCHMARK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = (F.trim("query") != "") & F.col("expected_status").isin("has_match", "no_match") & F.col("label_status").isin("provisional", "confirmed") & ((F.col("expected_status") == "no_match") == (F.size("relevant_main_skus") == 0))
    counted = df.join(df.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    wrong = F.raise_error(F.concat(F.lit("invalid benchmark item: "), F.coalesce("query_id", F.lit("?")))).cast("string")
    return counted.select(F.when(F.coalesce(ok & (F.col("n") == 1), F.lit(False)), F.col("query_id")).otherwise(wrong).alias("query_id"), *df.columns[1:])


def store_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified) of the store manifests that match a glob."""
    return spark.read.format("binaryFile").load(pattern).select("path", sc.iso_utc(F.col("modificationTime")).alias("modified"), sc.file_hash(F.col("content")).alias("sha256"), F.length("content").alias("bytes"))


def pictures(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, base64 without line breaks, sha256, bytes) of pictures."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.translate(F.base64("content"), "\r\n", "").alias("base64"), sc.file_hash(F.col("content")).alias("sha256"), F.length("content").alias("bytes"))


def vector_matrix(spark: SparkSession, matrix_path: str, rows_path: str) -> DataFrame:
    """(main_sku, vector) of a float32 matrix in NumPy's file format and a JSON array of its rows' ids, read and checked on one executor, as one file is."""

    def read(batches):
        for r in batches:
            for matrix, ids in zip(r.column(0).to_pylist(), r.column(1).to_pylist()):
                m, names = np.load(io.BytesIO(matrix), allow_pickle=False), json.loads(ids)
                if m.dtype != np.float32 or m.ndim != 2 or not m.shape[1]:
                    raise ValueError("a vector matrix is two-dimensional and float32")
                if not np.isfinite(m).all():
                    raise ValueError("a vector matrix has finite values only")
                if not isinstance(names, list) or not all(isinstance(n, str) and n for n in names) or len(names) != len(m) or len(set(names)) != len(names):
                    raise ValueError("vector rows are a JSON array of one id, not empty, for each row of the matrix, none twice")
                for a in range(0, len(m), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 4096]), pa.array(m[a : a + 4096].tolist(), pa.list_(pa.float32()))], names=["main_sku", "vector"])

    one = lambda path, name: spark.read.format("binaryFile").load(path).select(F.col("content").alias(name))
    both = one(matrix_path, "matrix").crossJoin(F.broadcast(one(rows_path, "ids")))  # a file each
    return both.mapInArrow(read, "main_sku string, vector array<float>")
