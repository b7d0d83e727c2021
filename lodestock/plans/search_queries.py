"""Search and fusion queries. Documents are the keyword corpus, embeddings the vectors; ids are one key space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark, fusion, rerank, search, vector_index
from ..operators.inverted import Inverted
from ..operators.vector_index import VectorIndex
from .registry import query, table
from .stored_index import kept, kept_index

#: The queries' tokens, and fields' weights as in a catalog: names, categories, aliases.
ASKED = {"q1": ("the", "thing"), "q2": ("ening", "stupid", "ratio"), "q3": ("license", "token")}
WEIGHTS = {"text": 8.0, "source": 4.0, "lang": 1.0}


def tokens(c: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def index_of(spark, sf_dir: str) -> Inverted:
    """The stored index of the documents; built by the first search of a state of the table."""
    return kept_index(spark, "documents", f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents"), "doc_id", {c: tokens(c) for c in WEIGHTS})


def asked(spark) -> DataFrame:
    return spark.createDataFrame([(q, t) for q, ts in ASKED.items() for t in ts], "query_id string, token string")


def keyword_hits(spark, sf_dir: str, k: int, **kw) -> DataFrame:
    return index_of(spark, sf_dir).search(asked(spark), k, weights=WEIGHTS, **kw)


def vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))


def vector_queries(spark, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


TOKENS = """tok as (select doc_id as doc, 'text' as field, 8.0::double as w, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) as token from documents
 union all select doc_id, 'source', 4.0::double, unnest(string_split_regex(lower(coalesce(source, '')), '[^a-z0-9]+')) from documents
 union all select doc_id, 'lang', 1.0::double, unnest(string_split_regex(lower(coalesce(lang, '')), '[^a-z0-9]+')) from documents),
post as (select doc, field, any_value(w) as w, token, count(*) as tf from tok where token <> '' group by doc, field, token)"""
BM25 = f"""with {TOKENS},
len as (select d.doc_id as doc, cast(coalesce(sum(tf), 0) as bigint) as size from documents d left join post on post.doc = d.doc_id group by d.doc_id),
stats as (select count(*) as n, avg(size) as mean from len),
ask as (select * from (values {', '.join(f"('{q}', '{t}')" for q, ts in ASKED.items() for t in ts)}) v(query_id, token)),
f as (select token, doc, sum(w * tf) as f from post where token in (select token from ask) group by token, doc),
df as (select token, count(*) as df from f group by token),
idf as (select token, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, stats),
scored as (select a.query_id, f.doc, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))), 9) as score from ask a join f using (token) join idf using (token) join len on len.doc = f.doc, stats {{scope}} group by a.query_id, f.doc),
kw as (select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) as rank from scored)"""


@query(f"""with {TOKENS} select token, cast(count(distinct doc) as bigint) as df, cast(sum(tf) as bigint) as tf from post group by token""")
def postings_stats(spark, sf_dir):
    tf = sum((F.col(f"tf_{c}") for c in WEIGHTS), F.lit(0))
    return index_of(spark, sf_dir).posts.groupBy("token").agg(F.count("*").alias("df"), F.sum(tf).alias("tf"))  # a posting is a document


@query(BM25.format(scope="") + " select query_id, doc, round(score, 6) as score, cast(rank as integer) as rank from kw where rank <= 20")
def keyword_search_bm25(spark, sf_dir):
    return keyword_hits(spark, sf_dir, 20).withColumn("score", F.round("score", 6))


@query(BM25.format(scope="where f.doc in (select doc_id from documents where lang = 'en')") + " select query_id, doc, round(score, 6) as score, cast(rank as integer) as rank from kw where rank <= 20")
def scoped_keyword_search(spark, sf_dir):
    scope = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("doc"))
    return keyword_hits(spark, sf_dir, 20, scope=scope).withColumn("score", F.round("score", 6))


def overlaid(spark, sf_dir: str) -> Inverted:
    """The documents' index with an overlay in which German documents have other texts."""
    docs = table(spark, sf_dir, "documents").where("lang = 'de'").withColumn("text", F.concat_ws(" ", "source", F.lit("license"), "lang"))
    fields = {c: tokens(c) for c in WEIGHTS}
    return index_of(spark, sf_dir).with_overlay(kept_index(spark, "overlay", f"{sf_dir}/documents.parquet", docs, "doc_id", fields, {"texts": "source license lang"}))


REPLACED = "replaced as (select doc_id, source, lang, case when lang = 'de' then concat_ws(' ', source, 'license', lang) else text end as text from documents), tok as"


@query(BM25.format(scope="").replace("documents", "replaced").replace("tok as", REPLACED, 1) + " select query_id, doc, round(score, 6) as score, cast(rank as integer) as rank from kw where rank <= 20")
def overlay_keyword_search(spark, sf_dir):
    return overlaid(spark, sf_dir).search(asked(spark), 20, weights=WEIGHTS).withColumn("score", F.round("score", 6))


def vector_sql(value: str, where: str = "true", k: int = 10) -> str:
    return f"""with s as (select q.vec_id as query_id, v.vec_id as doc, round({value}, 9) as score from embeddings q, embeddings v where q.vec_id % 50 = 0 and {where}),
r as (select *, row_number() over (partition by query_id order by score desc, doc) as rank from s) select query_id, doc, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= {k}"""


COSINE = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"


@query(vector_sql(COSINE))
def vector_topk(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(vector_sql("list_dot_product(q.embedding::double[], v.embedding::double[])"))
def vector_topk_dot(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, metric="dot").withColumn("score", F.round("score", 6))


@query(vector_sql(f"greatest(0, least(1, ({COSINE} + 1) / 2))"))
def vector_topk_unit(spark, sf_dir):
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, metric="unit").withColumn("score", F.round("score", 6))


@query(vector_sql(COSINE, "v.label = 1"))
def scoped_vector_topk(spark, sf_dir):
    scope = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc"))
    return search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, scope=scope).withColumn("score", F.round("score", 6))


def vector_index_of(spark, sf_dir: str) -> VectorIndex:
    """The stored inverted-file index of all embeddings."""
    now = kept(spark, "vectors", f"{sf_dir}/embeddings.parquet", {}, lambda: vector_index.index_tables(vectors(spark, sf_dir)), {"vectors": "list"})
    return VectorIndex(*(now.table(t) for t in ("vectors", "lists", "probes")))


@query(vector_sql(COSINE))
def ivf_topk(spark, sf_dir):
    """The exact answer from the index: nearest lists, then those that the triangle inequality leaves open."""
    return vector_index_of(spark, sf_dir).search(vector_queries(spark, sf_dir), 10, exact=True).withColumn("score", F.round("score", 6))


@query(vector_sql(f"greatest(0, least(1, ({COSINE} + 1) / 2))", "v.label = 1"))
def ivf_scoped_topk(spark, sf_dir):
    scope = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc"))
    return vector_index_of(spark, sf_dir).search(vector_queries(spark, sf_dir), 10, exact=True, metric="unit", scope=scope).withColumn("score", F.round("score", 6))


@query("select cast(count(*) as bigint) as queries, cast(count(*) * 10 as bigint) as wanted, true as recall_reached from embeddings where vec_id % 50 = 0")
def ivf_recall(spark, sf_dir):
    """Whether the nearest lists alone, as many as the index was calibrated to, hold at least nine tenths of the ten best of every asked vector, by brute force over all rows."""
    q = vector_queries(spark, sf_dir)
    near = vector_index_of(spark, sf_dir).search(q, 10)
    r = vector_index.recall(near, search.vector_search(vectors(spark, sf_dir), q, 10))
    return r.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"))


def channels(spark, sf_dir: str, k: int = 50) -> DataFrame:
    """Hits of keyword roles (q1 and, as an expansion, q2 are role 0, q3 role 1), and of each query vector, whose id is its role."""
    place = {"q1": (0, 1.0), "q2": (0, 0.7), "q3": (1, 1.0)}
    roles = spark.createDataFrame([(q, *p) for q, p in place.items()], "query_id string, role_id long, weight double")
    kw = keyword_hits(spark, sf_dir, k).join(F.broadcast(roles), "query_id").select("role_id", F.lit("keyword").alias("channel"), F.col("query_id").alias("query"), "weight", "doc", F.col("rank").alias("place"))  # three rows
    vec = search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), k)
    vec = vec.select(F.col("query_id").alias("role_id"), F.lit("vector").alias("channel"), F.concat(F.lit("v"), "query_id").alias("query"), F.lit(1.0).alias("weight"), "doc", F.col("rank").alias("place"))
    return kw.unionByName(vec)


FUSED = (
    BM25.format(scope="")
    + f""", vs as (select q.vec_id as query_id, v.vec_id as doc, round({COSINE}, 9) as score from embeddings q, embeddings v where q.vec_id % 50 = 0),
vr as (select *, row_number() over (partition by query_id order by score desc, doc) as rank from vs),
hits as (select r.role_id, 'keyword' as channel, kw.query_id as query, r.weight, doc, rank from kw join (values ('q1', 0, 1.0::double), ('q2', 0, 0.7::double), ('q3', 1, 1.0::double)) r(query_id, role_id, weight) using (query_id) where rank <= 50
 union all select query_id, 'vector', 'v' || query_id, 1.0::double, doc, rank from vr where rank <= 50),
fused as (select cast(role_id as bigint) as role_id, doc, round(sum(weight / (60 + rank)), 12) as exact, string_agg(distinct channel, ',' order by channel) as channels, string_agg(distinct query, ',' order by query) as queries, count(*) as n from hits group by role_id, doc),
ranked as (select *, row_number() over (partition by role_id order by exact desc, doc) as rank from fused)"""
)


@query(FUSED + " select role_id, doc, round(exact, 8) as score, channels, queries, cast(rank as integer) as rank from ranked where rank <= 40")
def hybrid_search(spark, sf_dir):
    f = fusion.fuse(channels(spark, sf_dir), limit=40)
    return f.select("role_id", "doc", F.round("score", 8).alias("score"), F.array_join("channels", ",").alias("channels"), F.array_join("matched_queries", ",").alias("queries"), "rank")


@query(FUSED + """, keep as (select * from ranked where doc in (select vec_id from embeddings where label <= 1)) select role_id, doc, round(exact, 8) as score, cast(row_number() over (partition by role_id order by exact desc, doc) as integer) as rank from keep qualify rank <= 25""".replace("qualify rank", "qualify row_number() over (partition by role_id order by exact desc, doc)"))
def fuse_known_products(spark, sf_dir):
    """Hits of no known product are dropped after their places are counted."""
    products = table(spark, sf_dir, "embeddings").where("label <= 1").select(F.col("vec_id").alias("main_sku"))
    return fusion.fuse(channels(spark, sf_dir), products=products, limit=25).select("role_id", "doc", F.round("score", 8).alias("score"), "rank")


@query(FUSED + " select role_id, doc, cast(n as bigint) as evidence_rows, cast(rank as integer) as rank from ranked where rank <= 10")
def fusion_evidence(spark, sf_dir):
    return fusion.fuse(channels(spark, sf_dir), limit=10).select("role_id", "doc", F.size("evidence").cast("long").alias("evidence_rows"), "rank")


@query("""with r as (select label, vec_id, row_number() over (partition by label order by vec_id) as place from embeddings union all select label + 1, vec_id, row_number() over (partition by label order by vec_id desc) from embeddings),
f as (select vec_id as main_sku, min((place, label)) as t from r group by vec_id)
select main_sku, cast(row_number() over (order by t, main_sku) as integer) as turn from f order by t, main_sku limit 60""")
def balanced_unique(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("label").alias("group_place"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("place"), F.col("vec_id").alias("main_sku"))
    b = e.select((F.col("label") + 1).alias("group_place"), F.row_number().over(W.partitionBy("label").orderBy(F.desc("vec_id"))).alias("place"), F.col("vec_id").alias("main_sku"))
    return rerank.balanced_unique(a.unionByName(b), 60).select("main_sku", "turn")


@query(f"""with s as (select q.vec_id as query_id, v.vec_id as doc, v.label as found, q.label as wanted, row_number() over (partition by q.vec_id order by round({COSINE}, 9) desc, v.vec_id) as place from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
h as (select query_id, bool_or(found = wanted) as hit from s where place <= 5 group by query_id)
select cast(count(*) as bigint) as queries, cast(count(*) filter (hit) as bigint) as hits, round(count(*) filter (hit) / count(*), 6) as hit_rate, false as enforced, true as passed from h""")
def hit_at_5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = search.vector_search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 6).where("query_id <> doc")
    results = benchmark.ranked_places(found.select("query_id", "doc", "score"))
    relevant = e.groupBy("label").agg(F.collect_list("vec_id").alias("relevant"))
    items = e.where("vec_id % 50 = 0").join(relevant, "label").select(F.col("vec_id").alias("query_id"), "relevant", F.lit("has_match").alias("expected_status"), F.lit("provisional").alias("label_status"))
    return benchmark.hit_rate(benchmark.hits(items, results))


@query("""select n.vec_id as main_sku, case when n.vec_id is null then 'removed' end as change from embeddings n where false
union all select coalesce(n.vec_id, o.vec_id), case when n.vec_id is null then 'removed' when n.t = o.t then 'reused' else 'changed' end from
(select vec_id, 't' || label as t from embeddings where vec_id % 4 <> 0) n full join (select vec_id, case when vec_id % 5 = 0 then 'old' else 't' || label end as t from embeddings where vec_id % 3 <> 0) o on n.vec_id = o.vec_id""")
def index_diff(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("main_sku"), F.concat(F.lit("t"), "label").alias("text"))
    old = e.where("main_sku % 3 <> 0").withColumn("text", F.when(F.col("main_sku") % 5 == 0, "old").otherwise(F.col("text")))
    return search.index_diff(e.where("main_sku % 4 <> 0"), old)


@query("""select cast(count(*) filter (c) as bigint) as cached, cast(count(*) filter (not c) as bigint) as missing from (select vec_id % 3 = 0 as c from embeddings)""")
def embedding_cache(spark, sf_dir):
    from ..functions.scalars import cache_key

    e = table(spark, sf_dir, "embeddings").select("vec_id", cache_key(F.lit("m"), F.col("vec_id").cast("string")).alias("cache_key"), F.col("embedding").alias("vector"))
    hit, miss = search.split_cached(e.drop("vector"), e.where("vec_id % 3 = 0"))
    return hit.agg(F.count("*").alias("cached")).crossJoin(miss.agg(F.count("*").alias("missing")))  # two single rows
