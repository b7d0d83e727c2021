"""python -m lodestock.cli: rebuild, status, search, rollback, update, stock."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import catalog, fusion, incremental, quality, stock
from .operators.inverted import index_tables
from .plans.retrieval import query_tokens
from .plans.stored_index import inverted
from .plans.versioning import Versions
from .sources import tables

FIELDS = ("cn_names", "leaf_categories", "en_aliases")
WEIGHTS = dict(zip(FIELDS, (8.0, 4.0, 1.0)))
#: What names the rows of each stored table.
STORED = {"keys": {"documents": ("main_sku",), "rows": ("sku",), "lengths": ("doc",)}, "partitions": {"postings": "bucket"}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestock")
    p.add_argument("--index-root", type=Path, default=Path("var/catalog"))
    c = p.add_subparsers(dest="command", required=True)
    a = c.add_parser("rebuild", help="build, check and publish a catalog from a source workbook")
    a.add_argument("--source", required=True)
    a.add_argument("--sheet")
    c.add_parser("status", help="the active version")
    a = c.add_parser("search", help="keyword search of the active version")
    a.add_argument("--query", required=True)
    a.add_argument("--expanded-query", action="append", default=[])
    a.add_argument("--platform")
    a.add_argument("--top-k", type=int, default=20, choices=range(1, 51), metavar="1..50")
    c.add_parser("rollback", help="swap the active and the previous version")
    a = c.add_parser("update", help="merge a partial source workbook; --apply publishes")
    a.add_argument("--source", required=True)
    a.add_argument("--apply", action="store_true")
    a = c.add_parser("stock", help="mains with stock by country from a snapshot workbook")
    a.add_argument("--source", required=True)
    return p


def build(spark: SparkSession, rows) -> dict:
    docs = catalog.build_documents(rows)
    indexed = tx.with_folded(docs.where("searchable").select("main_sku", *[tx.index_text(F.col(f)).alias(f) for f in FIELDS]), list(FIELDS))
    fields = {f: tx.index_words(F.col(f)) for f in FIELDS}
    return {"documents": docs, "rows": rows, **index_tables(indexed, "main_sku", fields)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestock").getOrCreate()
    versions = Versions(spark, str(args.index_root.absolute()))
    if args.command == "status":
        state = versions.state()
        print(json.dumps(state | {"manifest": versions.manifest(state["active"]) if state["active"] else None}, ensure_ascii=False))
        return 0
    if args.command == "rollback":
        print(versions.rollback())
        return 0
    path = f"file://{Path(args.source).absolute()}" if getattr(args, "source", None) else None
    checks = {"quality": lambda t: quality.validate_build(t["rows"], t["documents"])}
    if args.command == "rebuild":
        rows, left = catalog.split_unassigned(tables.source_rows(spark, path, args.sheet))
        digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        version = versions.rebuild({"source": digest, "sheet": args.sheet, "rules": "1"}, build(spark, rows.drop("sheet", "row")), checks, **STORED)
        print(json.dumps({"version": version, "unassigned_rows": left.count()}))
    elif args.command == "update":
        columns = catalog.ROW_FIELDS
        new = incremental.distinct_children(incremental.with_hashes(tables.source_rows(spark, path).drop("sheet", "row"), columns))
        old = incremental.with_hashes(versions.read("rows"), columns)
        report = incremental.upsert_report(incremental.compare_rows(new, old), old).first().asDict()
        if args.apply:
            merged = incremental.upsert(old, new, "sku").drop("row_hash", "evidence_hash")
            made = build(spark, merged)
            made["documents"] = incremental.merge_documents(versions.read("documents"), catalog.build_documents(new.drop("row_hash", "evidence_hash")))
            state = versions.state()["active"]
            report["version"] = versions.rebuild({"base": state, "update": quality.dataset_hash(new, "sku", "row_hash").first()[0]}, made, **STORED, base=state)
        print(json.dumps(report, ensure_ascii=False))
    elif args.command == "stock":
        for r in stock.availability(tables.snapshot_rows(spark, path)).orderBy("country").collect():
            print(json.dumps({"country": r["country"], "mains": r["mains"]}, ensure_ascii=False))
    else:
        asked = [(args.query, fusion.PRIMARY), *[(q, fusion.EXPANDED) for q in args.expanded_query]]
        terms = spark.createDataFrame([(q, q, w) for q, w in asked], "query_id string, query string, weight double")
        now = versions.snapshot()  # all three tables are of one version
        hits = inverted(now).search(query_tokens(terms), 50, weights=WEIGHTS)
        ranked = hits.join(terms, "query_id").select(F.lit("q").alias("role_id"), F.lit("keyword").alias("channel"), "query", "weight", "doc", F.col("rank").alias("place"))
        docs = now.table("documents")
        found = fusion.hybrid_search(ranked, docs, args.top_k, F.lit(args.platform.lower()) if args.platform else None)
        named = found.join(catalog.representative_name(docs), F.col("doc") == F.col("main_sku")).orderBy("rank")
        for r in named.collect():
            print(json.dumps({"rank": r["rank"], "main_sku": r["doc"], "name": r["name"], "score": round(r["score"], 8), "queries": r["matched_queries"], "eligible": r["eligible"], "warnings": r["warnings"]}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
