"""Queries over runs of stages, and whole retrievals: families past those that may not be sold, terms of roles, both scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import catalog, fusion, runs
from .catalog_queries import part_rows
from .registry import query, table
from .retrieval import both_scopes, distinct_families
from .stock_queries import CANDIDATES, IN_STOCK, annotated, candidates


@query("""with u as (select user_id as job, event_type as key, event_id as ord, case when value >= 20 then cast(floor(value) as bigint) end as amount, props as note from events),
l as (select job, key, max(ord) as last, max_by(note, ord) as note from u where amount is null group by all), t as (select u.job, u.key, cast(sum(amount) as bigint) as total from u left join l on u.job = l.job and u.key = l.key where amount is not null and (l.last is null or ord > l.last) group by all)
select coalesce(l.job, t.job) as job, coalesce(l.key, t.key) as key, coalesce(total, 0) as total, case when total is null then note end as note from l full join t on l.job = t.job and l.key = t.key""")
def usage_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.select(F.col("user_id").alias("job"), F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.when(F.col("value") >= 20, F.floor("value").cast("long")).alias("amount"), F.col("props").alias("note"))
    return runs.usage_totals(u, "job").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


@query("""with c as (select user_id as store, event_type as stage, cast(count(*) as bigint) as calls from events group by all), s as (select user_id as store, event_type as stage, cast(sum(floor(value)) as bigint) as spent, cast(sum(case when value >= 20 then 1 end) as bigint) as large from events group by all)
select store, stage, calls, spent, large from c join s using (store, stage)""")
def stage_receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("store"), F.col("event_type").alias("stage"), F.col("event_id").alias("call"), "value")
    u = e.select("store", "stage", F.lit("spent").alias("key"), F.floor("value").cast("long").alias("amount")).unionByName(e.select("store", "stage", F.lit("large").alias("key"), F.when(F.col("value") >= 20, F.lit(1).cast("long")).alias("amount")))
    r = runs.merged_receipts(e, u)
    return r.select("store", "stage", "calls", F.try_element_at("usage", F.lit("spent")).alias("spent"), F.try_element_at("usage", F.lit("large")).alias("large"))


@query("""with w as (select o_custkey as store, cast(o_orderkey as varchar) as scene, o_orderpriority as request from orders)
select store, scene, request from w join orders on scene = cast(o_orderkey as varchar) where not (o_orderstatus = 'F' and o_orderpriority <> '1-URGENT')""")
def unfinished_scenes(spark, sf_dir):
    """Orders are scenes: those of status F have a result, of which the urgent ones' content isn't what was recorded."""
    o = table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_custkey").alias("store"), F.col("o_orderkey").cast("string").alias("scene"), F.col("o_orderpriority").alias("request"))
    made = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").cast("string").alias("scene"), F.col("o_orderpriority").alias("request"), F.lit("a").alias("recorded"), F.when(F.col("o_orderpriority") == "1-URGENT", "b").otherwise("a").alias("found"))
    return runs.unfinished(wanted, made)


@query("""select c_custkey as store, case when c_mktsegment = 'BUILDING' then 'running' when c_acctbal < 0 then 'no_retrieval' when c_nationkey < 5 then 'no_child_stock' when c_acctbal > 8000 then 'outdated' end as blocked from customer""")
def export_readiness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("store"), F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("done").alias("status"), (F.col("c_acctbal") >= 0).alias("has_retrieval"),
        (F.col("c_nationkey") >= 5).alias("has_child_stock"), (F.col("c_acctbal") > 8000).alias("outdated"),
    )
    return runs.export_blocked(c).select("store", "blocked")


@query(f"with {CANDIDATES} select scene, role, string_agg(main_sku || ':' || rank, ',' order by rank) as candidates from cand where rank <= 12 group by scene, role")
def judged_candidates(spark, sf_dir):
    """Twelve of a scene's brands, so that the limit shows."""
    j = runs.for_judging(candidates(spark, sf_dir), "scene", "role", most=12, fields={"main_sku": "main_sku", "rank": "rank"})
    return j.select("scene", "role", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["main_sku"], c["rank"])), ",").alias("candidates"))


@query(f"with {IN_STOCK} select 'all' as mode, scene, main_sku from ann union all select 'in_stock', scene, main_sku from ann where country_available union all select 'picked', scene, main_sku from ann where rank <= 3")
def visible_candidates(spark, sf_dir):
    c = annotated(spark, sf_dir).withColumn("picked", F.when(F.col("rank") <= 3, F.lit(True)))
    out = None
    for mode in ("all", "in_stock", "picked"):
        part = runs.visible(c, mode).select(F.lit(mode).alias("mode"), "scene", "main_sku")
        out = part if out is None else out.unionByName(part)
    return out


# Families of a brand and a size: those of a size divisible by 7 are banned as a whole.
def sized_documents(spark, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_size")
    rows = part_rows(spark, sf_dir).join(size, "ord").withColumn("main_sku", F.concat_ws("-", "main_sku", "p_size")).drop("p_size")
    return catalog.build_documents(rows, ascii_only=True)


def sized_hits(spark, sf_dir: str, scope: DataFrame | None = None, most: int = 60) -> DataFrame:
    """Two channels a market segment, each the `most` first families by a hash."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("doc")).distinct()
    if scope is not None:
        p = p.join(scope, "doc", "left_semi")
    roles = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role_id")).distinct()  # a handful
    out = None
    for channel, weight, h in (("a", 1.0, F.sha2(F.concat("role_id", "doc"), 256)), ("b", 0.7, F.sha2(F.concat("doc", "role_id"), 256))):
        place = F.row_number().over(W.partitionBy("role_id").orderBy(h))
        part = p.crossJoin(F.broadcast(roles)).select("role_id", F.lit(channel).alias("channel"), F.lit("q").alias("query"), F.lit(weight).alias("weight"), "doc", place.alias("place")).where(F.col("place") <= most)
        out = part if out is None else out.unionByName(part)
    return out


def sized_sql(scope: str, name: str) -> str:
    return f"""fam{name} as (select distinct p_brand || '-' || p_size as doc, p_size from part where {scope}), role{name} as (select distinct c_mktsegment as role_id from customer),
hit{name} as (select * from (select role_id, 'a' as channel, 1.0::double as weight, doc, row_number() over (partition by role_id order by sha256(role_id || doc)) as place from fam{name}, role{name}
 union all select role_id, 'b', 0.7::double, doc, row_number() over (partition by role_id order by sha256(doc || role_id)) from fam{name}, role{name}) where place <= 60),
fus{name} as (select role_id, doc, round(sum(weight / (60 + place)), 12) as score from hit{name} group by role_id, doc),
run{name} as (select role_id, doc, score, row_number() over (partition by role_id order by score desc, doc) as rank from fus{name} join fam{name} using (doc) where p_size % 7 <> 0)"""


@query(f"with {sized_sql('true', '')} select role_id, doc, round(score, 8) as score, cast(rank as integer) as rank from run where rank <= 30")
def hybrid_families(spark, sf_dir):
    """Fused channels, filled up past families that may not be sold on the platform."""
    found = fusion.hybrid_search(sized_hits(spark, sf_dir), sized_documents(spark, sf_dir), 30, F.lit("shopee"))
    return found.select("role_id", "doc", F.round("score", 8).alias("score"), "rank")


@query(f"""with {sized_sql('true', 'g')}, {sized_sql("p_type like 'PROMO%' or p_size < 20", 'c')}, both_runs as (select role_id, doc, 0 as place, rank from rung where rank <= 20 union all select role_id, doc, 1, rank from runc where rank <= 20)
select role_id, doc, min(place) = 0 as global, cast(arg_min(rank, place) as integer) as rank from both_runs group by role_id, doc""")
def scoped_families(spark, sf_dir):
    """A global run and one in a country's scope, each family once, the global run first."""
    in_country = table(spark, sf_dir, "part").where("p_type like 'PROMO%' or p_size < 20").select(F.concat_ws("-", "p_brand", "p_size").alias("doc")).distinct()
    found = both_scopes(lambda scope: sized_hits(spark, sf_dir, scope), in_country, sized_documents(spark, sf_dir), 20, F.lit("shopee"))
    return distinct_families(found).select("role_id", "doc", (F.col("first.scope_place") == 0).alias("global"), F.col("first.rank").alias("rank"))


@query("""with t as (select n_nationkey as role_id, 'cn' as language, n_name as query, 1.0::double as weight from nation union all select n_nationkey, 'cn', r_name, 0.7 from nation join region on n_regionkey = r_regionkey where r_name <> n_name
 union all select n_nationkey, 'en', lower(n_name), 1.0 from nation union all select n_nationkey, 'en', n_name || ' goods', 1.0 from nation) select role_id, language, query, weight from t""")
def query_terms(spark, sf_dir):
    """Terms of roles: each once a language, the first terms before expansions, blank ones left out."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    roles = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("product_cn"), F.lower("n_name").alias("product_en"), F.concat("n_name", F.lit(" ")).alias("canonical_cn"), F.concat("n_name", F.lit(" goods")).alias("canonical_en"),
        F.array("r_name", "n_name", F.lit(" ")).alias("expanded_cn"), F.lit(None).cast("array<string>").alias("expanded_en"),
    )
    return fusion.role_terms(roles).select("role_id", "language", "query", "weight")
