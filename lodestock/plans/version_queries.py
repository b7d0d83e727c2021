"""Versions, pinned reads and comparisons by hash tree, on the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog
from ..sources.store import shared_folder
from .catalog_queries import part_rows
from .registry import query, table
from .versioning import Versions


def fresh(spark) -> Versions:
    return Versions(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")


@query("""select p_brand as main_sku, cast(count(*) as integer) as children from part where p_partkey % 2 = 0 group by p_brand""")
def version_rollback(spark, sf_dir):
    """Two versions of a catalog are published, of other parts each; after a rollback the first is in force again."""
    v = fresh(spark)
    rows = part_rows(spark, sf_dir)
    for cut in ("ord % 2 = 0", "ord % 3 = 0"):
        v.rebuild({"source": cut, "rules": "1"}, {"documents": catalog.build_documents(rows.where(cut), ascii_only=True)}, keys={"documents": ("main_sku",)})
    v.rollback()
    return v.read("documents").select("main_sku", F.size("children").alias("children"))


@query("""select o_custkey as customer, cast(count(*) as bigint) as orders, cast(2 as integer) as tries from orders group by o_custkey""")
def pinned_read(spark, sf_dir):
    """Orders by customer from two tables of one version. A second version, of all orders, is published between the first try's plan and its action, which is therefore discarded."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    v, seen = fresh(spark), []
    of = lambda d: {"orders": d, "customers": d.select("o_custkey").distinct()}
    keys = {"orders": ("o_orderkey",)}
    v.rebuild({"orders": "finished"}, of(orders.where("o_orderstatus = 'F'")), keys=keys)

    def plan(now):
        joined = now.table("orders").join(now.table("customers"), "o_custkey").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"))
        seen.append(now.version)
        if len(seen) == 1:
            v.rebuild({"orders": "all"}, of(orders), keys=keys)
        return joined

    def act(df):
        path = f"{v.store.root}/result-{len(seen)}"
        df.withColumn("tries", F.lit(len(seen))).write.parquet(path)
        return spark.read.parquet(path)

    return v.pinned(plan, act)


@query("""select 'parts' as table_name, p_partkey as id, case p_size when 1 then 'removed' else 'changed' end as change from part where p_size in (1, 2)
union all select 'parts', p_partkey + 1000000000, 'added' from part where p_size = 3
union all select 'vectors', vec_id, case label when 0 then 'removed' else 'changed' end from embeddings where label in (0, 1)""")
def version_differences(spark, sf_dir):
    """What a second version of parts and vectors removed, changed and added, found by the trees of both."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    later = parts.where("p_size <> 1").withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_size") == 2, 1.0).otherwise(0.0)).unionByName(parts.where("p_size = 3").withColumn("p_partkey", F.col("p_partkey") + 1000000000))
    turned = vectors.where("label <> 0").withColumn("embedding", F.when(F.col("label") == 1, F.reverse("embedding")).otherwise(F.col("embedding")))
    v = fresh(spark)
    old = v.rebuild({"v": "1"}, {"parts": parts, "vectors": vectors})
    new = v.rebuild({"v": "2"}, {"parts": later, "vectors": turned}, base=old)
    v.require_base(new, old)
    out = [v.differences(old, new, name).toDF("id", "change").select(F.lit(name).alias("table_name"), "id", "change") for name in ("parts", "vectors")]
    return out[0].unionByName(out[1])


@query("""select coalesce(doc_id, vec_id) as doc_id, case when vec_id is null then 'documents' else 'vectors' end as only_in from documents full join embeddings on doc_id = vec_id where doc_id is null or vec_id is null""")
def unmatched_vectors(spark, sf_dir):
    """Documents without a vector and vectors without a document, within a version."""
    v = fresh(spark)
    made = v.rebuild({"v": "1"}, {"documents": table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "vectors": table(spark, sf_dir, "embeddings").select("vec_id", "label")})
    return v.unmatched_keys(made, "documents", "vectors").select(F.col("doc_id").cast("long").alias("doc_id"), "only_in")
