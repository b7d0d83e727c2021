"""A store's whole retrieval: roles' terms over four channels, fused, with a country's stock, cut to what is in stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion
from .params import SearchParams
from .registry import query, table
from .retrieval import bilingual_fields, retrieve
from .stored_index import kept_index


def products_of(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("main_sku"), F.col("p_name").alias("standard_name_cn"), F.concat_ws(" ", "p_name", "p_type").alias("standard_name_en"))


def roles_of(spark, sf_dir: str) -> DataFrame:
    """A role for each name of a part: its words are terms of one language, its types and the name those of the other."""
    words = F.split("p_name", " ")
    g = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_type").alias("least"), F.max("p_type").alias("most"))
    return g.select(F.col("p_name").alias("role_id"), F.col("p_name").alias("product_cn"), F.col("least").alias("product_en"), F.get(words, F.lit(0)).alias("canonical_cn"), F.col("most").alias("canonical_en"), F.array(F.get(words, F.lit(1))).alias("expanded_cn"), F.array("p_name").alias("expanded_en"))


STORE_SQL = """with pr as (select 'P' || p_partkey as doc, lower(p_name) as cn, lower(p_name || ' ' || p_type) as en from part),
tok as (select doc, 'cn' as field, unnest(regexp_extract_all(cn, '[a-z0-9]+')) as token from pr union all select doc, 'en', unnest(regexp_extract_all(en, '[a-z0-9]+')) from pr),
post as (select doc, field, token, count(*) as tf from tok group by all), len as (select doc, sum(tf) as size from post group by doc), stats as (select count(*) as n, avg(size) as mean from len),
r as (select p_name as role_id, split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2, min(p_type) as t0, max(p_type) as t1 from part group by p_name),
raw as (select role_id, 'cn' as language, w1 as query, 1.0::double as weight, 0 as place from r union all select role_id, 'cn', role_id, 1.0, 1 from r union all select role_id, 'cn', w2, 0.7, 2 from r
 union all select role_id, 'en', t1, 1.0, 0 from r union all select role_id, 'en', t0, 1.0, 1 from r union all select role_id, 'en', role_id, 0.7, 2 from r),
terms as (select role_id, language, query, arg_min(weight, place) as weight from raw group by role_id, language, query), once as (select distinct language, query from terms),
ask as (select language as field, query, unnest(list_distinct(regexp_extract_all(query, '[A-Za-z0-9]+'))) as tok from once),
df as (select field, token, count(*) as df from post group by all),
idf as (select field, token, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, stats),
sc as (select a.field as language, a.query, p.doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) as score from ask a join post p on p.field = a.field and p.token = lower(a.tok) join idf i on i.field = p.field and i.token = p.token join len on len.doc = p.doc, stats group by a.field, a.query, p.doc),
vs as (select language, query, 'P' || v.vec_id as doc, round(list_dot_product(t.embedding::double[], (case language when 'en' then list_reverse(v.embedding) else v.embedding end)::double[]), 9) as score from once join embeddings t on t.vec_id = ascii(query), embeddings v),
ranked as (select language || '_keyword' as channel, language, query, doc, row_number() over (partition by language, query order by score desc, doc) as place from sc
 union all select language || '_vector', language, query, doc, row_number() over (partition by language, query order by score desc, doc) from vs),
hits as (select role_id, channel, t.query, weight, doc, place from terms t join ranked k on k.language = t.language and k.query = t.query where place <= 100 and doc in (select doc from pr)),
fused as (select role_id, doc, round(sum(weight / (60 + place)), 12) as score, string_agg(distinct channel, ',' order by channel) as channels, string_agg(distinct query, ',' order by query) as queries from hits group by role_id, doc),
global as (select *, row_number() over (partition by role_id order by score desc, doc) as rank from fused),
stock as (select 'P' || l_partkey as doc, sum(l_quantity) as quantity from lineitem where l_returnflag = 'R' group by l_partkey),
kept as (select g.*, quantity, row_number() over (partition by role_id order by rank) as place from global g join stock using (doc) where rank <= 400 and quantity > 0)"""


def searched(spark, sf_dir: str):
    products, roles = products_of(spark, sf_dir), roles_of(spark, sf_dir)
    docs, fields = bilingual_fields(products)
    index = kept_index(spark, "products", f"{sf_dir}/part.parquet", docs, "main_sku", fields)
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("P"), "vec_id").alias("main_sku")
    vectors = e.select(F.lit("cn").alias("language"), name, F.col("embedding").alias("vector")).unionByName(e.select(F.lit("en").alias("language"), name, F.reverse("embedding").alias("vector")))
    terms = fusion.role_terms(roles).select("language", "query").distinct()
    term_vectors = terms.join(e, F.ascii("query") == F.col("vec_id")).select("language", "query", F.col("embedding").alias("vector"))
    stock = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias("quantity")).select(F.concat(F.lit("P"), "l_partkey").alias("main_sku"), "quantity")
    return retrieve(roles, products, vectors, term_vectors, stock, SearchParams(stock_filter="in_stock"), weighted=True, index=index)


@query(STORE_SQL + " select role_id, doc as main_sku, cast(place as integer) as rank, round(score, 8) as rrf_score, channels, queries, round(quantity, 4)::double as quantity from kept where place <= 30")
def store_retrieval(spark, sf_dir):
    kept, _ = searched(spark, sf_dir)
    return kept.select("role_id", "main_sku", "rank", "rrf_score", F.array_join("channels", ",").alias("channels"), F.array_join("matched_queries", ",").alias("queries"), F.col("country_available_quantity").alias("quantity"))


@query(STORE_SQL + """ select r.role_id, coalesce(f.n, 0) as candidate_count_before_stock, case when k.n > 0 then 'matched' when f.n > 0 then 'no_stock_in_recalled_candidates' else 'no_candidates_in_recall_window' end as match_status
from r left join (select role_id, count(*) as n from global where rank <= 400 group by role_id) f using (role_id) left join (select role_id, count(*) as n from kept where place <= 30 group by role_id) k using (role_id)""")
def store_match_status(spark, sf_dir):
    return searched(spark, sf_dir)[1]
