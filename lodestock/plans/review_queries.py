"""Catalog rows, clues, answers, reviews and stages, each over whole tables with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, clues, incremental, rerank, runs, search
from ..sources import tables
from . import stages
from .catalog_queries import part_documents, part_rows
from .change_queries import SEEN, seen_clues
from .registry import query, table
from .stock_queries import CANDIDATES, SCENES, VERDICTS, candidates, scene_candidates, verdicts


@query("""select 'C' || p_partkey as sku, case when p_size % 5 = 0 then 'audit' else 'kept' end as route from part where p_size % 5 = 0 or (p_type <> 'PROMO' and p_size % 7 <> 0)""")
def assigned_rows(spark, sf_dir):
    """Parts of a size divisible by 5 have no main SKU, others of one divisible by 7 the excluded one; promotion parts are on the exclusion list."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    rows = p.select(F.concat(F.lit("C"), "p_partkey").alias("sku"), F.when(size % 5 == 0, "  ").when(size % 7 == 0, "1a0000").otherwise(F.col("p_brand")).alias("main_sku"))
    has, audit = catalog.split_unassigned(rows)
    kept = catalog.without_excluded(has, p.where("p_type = 'PROMO'").select(F.concat(F.lit("C"), "p_partkey").alias("sku")))
    return audit.select("sku", F.lit("audit").alias("route")).unionByName(kept.select("sku", F.lit("kept").alias("route")))


@query("""select 'P' || p_partkey as main_sku, p_name as standard_name_cn from part where p_size % 2 = 1 and p_type <> 'PROMO'""")
def active_products(spark, sf_dir):
    """Inactive and unindexable products are left out before names are checked: inactive ones have none."""
    active = F.col("p_size") % 2
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("main_sku"), active.alias("active"), (F.col("p_type") != "PROMO").cast("int").alias("indexable"), F.when(active == 1, F.col("p_name")).otherwise("").alias("standard_name_cn"), F.col("p_name").alias("standard_name_en")
    )
    return tables.products(p).select("main_sku", "standard_name_cn")


@query("""select 'P' || p_partkey as main_sku, cast(0 as integer) as place, 'C' || p_partkey as child_sku, p_name as child_name from part union all select 'P' || p_partkey, 1, 'D' || p_partkey, '' from part""")
def product_children(spark, sf_dir):
    """Two children of each product and a blank one, read from JSON; one child has a name."""
    key, lit = F.col("p_partkey").cast("string"), F.lit
    p = table(spark, sf_dir, "part").select(
        F.concat(lit("P"), key).alias("main_sku"), F.concat(lit('{"child_skus": [" C'), key, lit('", " ", "D'), key, lit('"]}')).alias("inventory_metadata_json"),
        F.concat(lit('[{"child_sku": "C'), key, lit(' ", "raw": {"商品名称": " '), "p_name", lit(' "}}, {"child_sku": "D'), key, lit('", "raw": {}}]')).alias("raw_evidence_json"),
    )
    return tables.product_children(p, strict=True)


@query("""select vec_id as main_sku, cast(embedding[1] as double) as first_value, cast(embedding[64] as double) as last_value from embeddings""")
def checked_embeddings(spark, sf_dir):
    e = tables.embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("main_sku"), F.col("embedding").alias("vector")), 64)
    return e.select("main_sku", F.col("vector")[0].cast("double").alias("first_value"), F.col("vector")[63].cast("double").alias("last_value"))


@query("""select vec_id as main_sku, 'cn,en' as languages from embeddings where label <= 3""")
def bilingual_vectors(spark, sf_dir):
    """Every row has a Chinese vector, those of the first labels an English one too."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("main_sku"), F.col("embedding").alias("vector"), "label")
    cn = e.select("main_sku", "vector", F.lit("cn").alias("language"), F.lit("a").alias("model_key"))
    en = e.where("label <= 3").select("main_sku", "vector", F.lit("en").alias("language"), F.lit("b").alias("model_key"))
    both = search.embedding_intersection(cn.unionByName(en))
    return both.select("main_sku", F.array_join(F.array_sort(F.map_keys("vectors")), ",").alias("languages"))


@query("""select n_name as image, n_regionkey > 1 as unread, r_name as note from nation join region on n_regionkey = r_regionkey""")
def image_frames(spark, sf_dir):
    """Nations are pictures: those of the first two regions are read; each has a frame."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    images = n.select(F.col("n_name").alias("image"), F.col("n_nationkey").alias("image_place"))
    frames = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("image"), F.col("r_name").alias("note"))
    unread = clues.unread_images(images, n.where("n_regionkey <= 1").select(F.col("n_name").alias("image"))).select("image", F.lit(True).alias("unread"))
    return clues.frames_for(images, frames).join(unread, "image", "left").select("image", F.coalesce("unread", F.lit(False)).alias("unread"), "note")


@query("""with f as (select c_mktsegment as scene, list_sort(list(distinct n_name)) as products from customer join nation on c_nationkey = n_nationkey where c_mktsegment <> 'BUILDING' group by 1)
select s.scene, coalesce(array_to_string(products, ','), '') as products from (select distinct c_mktsegment as scene from customer) s left join f using (scene)""")
def scene_products(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.where("c_mktsegment <> 'BUILDING'").join(n, c["c_nationkey"] == n["n_nationkey"])
    frames = j.groupBy(F.col("c_mktsegment").alias("scene")).agg(F.array_sort(F.collect_set("n_name")).alias("products"))
    scenes = c.select(F.col("c_mktsegment").alias("scene")).distinct()
    return clues.scene_frames(scenes, frames).select("scene", F.array_join("products", ",").alias("products"))


@query("""with r as (select doc_id % 7 as role_id, doc_id % 40 as main_sku, cast(quality * 2 + toxic as integer) as level, doc_id as place from labels), f as (select *, row_number() over (partition by role_id, main_sku order by place) as n from r where level between 1 and 3 and main_sku % 3 <> 0),
g as (select *, row_number() over (partition by role_id order by level desc, place) as rank from f where n = 1) select role_id, main_sku, level, cast(rank as integer) as rank from g where rank <= 5""")
def held_levels(spark, sf_dir):
    """A model's levels: those out of range, of pairs never asked and beyond the limit have no effect."""
    r = table(spark, sf_dir, "labels").select((F.col("doc_id") % 7).alias("role_id"), (F.col("doc_id") % 40).alias("main_sku"), (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("level"), F.col("doc_id").alias("place"))
    return rerank.bounded_levels(r, r.where("main_sku % 3 <> 0"), limit=5).select("role_id", "main_sku", "level", "rank")


@query(f"""with {CANDIDATES}, {VERDICTS} select scene, main_sku, verdict, case when p between 0 and 1 then p end as probability from cand join ver using (scene, main_sku)
where verdict is not null and not (scene = 'BUILDING' and rank <= 10) and not (scene = 'MACHINERY' and rank between 11 and 20)""")
def read_answers(spark, sf_dir):
    """The first batch of one scene names a SKU that wasn't asked, the second of another names one twice: both are refused whole."""
    c = candidates(spark, sf_dir)
    asked = rerank.question_batches(c.withColumn("role_place", F.lit(0)), 10)
    answers = asked.join(verdicts(spark, sf_dir), ["scene", "main_sku"]).select("scene", "batch", "main_sku", "verdict", "probability", "rank")
    foreign = answers.where("scene = 'BUILDING' and rank = 1").withColumn("main_sku", F.lit("foreign"))
    given = answers.unionByName(foreign).unionByName(answers.where("scene = 'MACHINERY' and rank = 11")).drop("rank")
    return rerank.read_answers(given, asked.select("scene", "batch", "main_sku"))


@query(f"with {SCENES} select scene, role, main_sku, main_sku % 4 as relevance, cast(row_number() over (partition by scene, role order by main_sku % 4 desc, rank) as integer) as place from sr where main_sku % 4 >= 2")
def recommended(spark, sf_dir):
    r = scene_candidates(spark, sf_dir).select("scene", F.col("role").alias("product_cn"), F.lit("e").alias("product_en"), "main_sku", "rank")
    judged = r.drop("rank").withColumn("relevance", F.col("main_sku") % 4)
    return rerank.recommendations(r, judged, 2).select("scene", F.col("product_cn").alias("role"), "main_sku", "relevance", "place")


@query("""with d as (select *, p_brand like '%1' and p_size < 10 as gone from part), g as (select p_brand, bool_or(gone) as any_gone, min(p_name) filter (not gone) as first_name, arg_min(p_name || ' C' || p_partkey, p_partkey) filter (not gone) as live from d group by p_brand)
select p_brand as main_sku, coalesce(case when any_gone then live end, first_name, '') as name from g""")
def representative_names(spark, sf_dir):
    """The first name of a family; where children are excluded, the name of the first that isn't."""
    out = table(spark, sf_dir, "part").where("p_brand like '%1' and p_size < 10").select(F.concat(F.lit("C"), "p_partkey").alias("sku"))
    return catalog.representative_names(catalog.family_entries(part_rows(spark, sf_dir), out, ascii_only=True))


@query("""select p_brand as main_sku, cast(count(*) as bigint) as children from part where p_brand = 'Brand#13' group by p_brand""")
def point_lookup(spark, sf_dir):
    return catalog.get_document(part_documents(spark, sf_dir), "  Brand#13 ").select("main_sku", F.size("children").cast("long").alias("children"))


@query(f"""with {SEEN}, c as (select distinct clue from seen union all select 'by hand') select clue, case when clue in ('click', 'error') then '运营手动排除' else 'kept' end as state from c""")
def analysis_input(spark, sf_dir):
    """Kept clues, one added by hand among them, and the excluded ones with the reason."""
    out = spark.createDataFrame([("click",), ("error",)], "clue string")
    manual = spark.createDataFrame([(0, "by hand"), (1, " view "), (2, " ")], "ord int, name_cn string")
    kept, gone = clues.analysis_input(clues.review_clues(clues.merge_clues(seen_clues(spark, sf_dir)), out, manual))
    return kept.select("clue", F.lit("kept").alias("state")).unionByName(gone.select("clue", F.col("reason").alias("state")))


@query(f"""with {SEEN} select clue, cast(count(distinct image) as bigint) as image_count, cast(count(*) as bigint) as occurrences from seen where image <> 3 and lower(event_type) <> 'error' group by clue""")
def dropped_image(spark, sf_dir):
    """Sightings less one picture's, and less those whose name, in any case, is excluded."""
    seen = seen_clues(spark, sf_dir).withColumn("sort", F.split("name", "、")[0])
    left = clues.without_named(clues.drop_image(seen, "3"), "sort", spark.createDataFrame([("ERROR",)], "clue string"))
    return clues.merge_clues(left.drop("sort")).select("clue", "image_count", "occurrences")


@query("""select p_brand as main_sku, array_to_string(list_sort(list(distinct p_name || ' C' || p_partkey)), '|') as cn_names, array_to_string(list_sort(list(distinct p_name)), '|') as english, array_to_string(list_sort(list_concat(list(distinct p_type), ['catalog'])), '|') as categories from part group by p_brand""")
def review_evidence(spark, sf_dir):
    e = incremental.review_evidence(part_rows(spark, sf_dir))
    return e.select("main_sku", *[F.array_join(c, "|").alias(c) for c in ("cn_names", "english", "categories")])


@query("""select p_brand as main_sku, case when p_brand like '%3' or p_brand = 'Brand#11' then 'h1' else 'h0' end as evidence_hash from (select distinct p_brand from part) where p_brand not like '%2' and (p_brand not like '%1' or p_brand = 'Brand#11')""")
def pending_reviews(spark, sf_dir):
    """Reviewed families stay so unless their evidence changed (one did); new ones come in; one group is answered."""
    mains = table(spark, sf_dir, "part").select(F.col("p_brand").alias("main_sku")).distinct()
    ends = lambda s: F.col("main_sku").endswith(s)
    queue = mains.where(~ends("5")).select("main_sku", F.lit("h0").alias("evidence_hash"), F.when(ends("1"), "reviewed").otherwise("pending").alias("status"))
    evidence = mains.select("main_sku", F.when(ends("3") | (F.col("main_sku") == "Brand#11"), "h1").otherwise("h0").alias("evidence_hash"))
    now = incremental.refresh_queue(queue, evidence, mains.where(~ends("4")))
    answered = incremental.apply_reviews(now, mains.where(ends("2")).select("main_sku", F.lit("h0").alias("evidence_hash")))
    return incremental.pending(answered).select("main_sku", "evidence_hash")


def _text(v: str | None) -> str:
    return "null" if v is None else f"'{v}'"


STAGES = "st as (select * from (values " + ", ".join(f"({i}, '{s}', {_text(None if stages.FILES[s][0] == 'images' else stages.FILES[s][0])}, '{stages.FILES[s][1]}')" for i, s in enumerate(stages.ORDER)) + ") v(place, stage, source, made))"
#: Each customer is a store whose file of one stage is older than the others, or missing; a segment's stores never finished their last stage.
BEHIND = f"""{STAGES}, fl as (select c_custkey as store, made as name, case when place = c_nationkey % 8 then 0 else place + 1 end as modified from customer, st where not (place = c_nationkey % 8 and c_acctbal > 5000)),
own as (select c_custkey as store, c_mktsegment as country, st.place, st.stage, (c_mktsegment = 'BUILDING' and st.place = 7) or m.modified is null or coalesce(r.modified > m.modified, false) or (st.stage = 'scenes' and c_acctbal < 0) or (st.place = 0 and c_nationkey = 23) as late
 from customer cross join st left join fl m on m.store = c_custkey and m.name = made left join fl r on r.store = c_custkey and r.name = source),
behind as (select store, country, place, stage, bool_or(late) over (partition by store order by place) as behind from own)"""


def store_stages(spark, sf_dir: str):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "store")
    st = stages.stage_table(spark)
    each = c.crossJoin(F.broadcast(st))  # eight stages
    old = F.col("place") == F.col("c_nationkey") % 8
    files = each.where(~(old & (F.col("c_acctbal") > 5000))).select("store", F.col("made").alias("name"), F.when(old, 0).otherwise(F.col("place") + 1).alias("modified"))
    finished = each.where("not (c_mktsegment = 'BUILDING' and place = 7)").select("store", "stage")
    was = c.select("store", F.lit("scenes").alias("stage"), F.lit("temperature").alias("key"), F.lit("0.5").alias("value")).unionByName(c.select("store", F.lit("expand").alias("stage"), F.lit("scene_count").alias("key"), F.lit("9").alias("value")))
    recorded = stages.settings_read(was)
    now = c.select("store", F.lit("temperature").alias("key"), F.when(F.col("c_acctbal") < 0, "0.7").otherwise("0.5").alias("value"))
    pictures = c.select("store", F.lit("a.png").alias("picture"))
    unread = runs.unread_pictures(pictures, c.where("c_nationkey <> 23").select("store", F.lit("a.png").alias("picture")))
    return runs.stale_stages(st, c.select("store"), files, finished, recorded, now, unread)


@query(f"with {BEHIND} select store, stage, cast(place as integer) as place, behind from behind")
def stale_stages(spark, sf_dir):
    return store_stages(spark, sf_dir).select("store", "stage", "place", "behind")


@query(f"""with {BEHIND}, n as (select store, country, arg_min(stage, place) filter (behind) as next_stage, cast(count(*) filter (behind) as bigint) as stages_left from behind group by store, country)
select *, cast(floor((row_number() over (partition by country order by store) - 1) / 20.0) as bigint) as batch from n where stages_left > 0""")
def store_batches(spark, sf_dir):
    """What each store that isn't ready has to run next, in batches of twenty a country (here: market segment)."""
    todo = runs.next_stages(store_stages(spark, sf_dir)).where("stages_left > 0")
    country = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("store"), F.col("c_mktsegment").alias("country"))
    return runs.store_batches(todo.join(country, "store"), 20).select("store", "country", "next_stage", "stages_left", "batch")
