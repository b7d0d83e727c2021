"""Text, scalar and array expressions over whole tables. Parts' sizes decide which shape of a value a row gets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import rerank, search
from .registry import query, table
from .retrieval import bilingual_fields, query_tokens
from .stored_index import kept_index
from .stock_queries import CANDIDATES, candidates


@query("""select p_partkey, case when p_size % 3 = 0 then p_name when p_size % 3 = 1 then '链接拍' || p_name else p_name || ' x' end as name from part""")
def operational_names(spark, sf_dir):
    """Names with two markers of operational text, with one that begins them, and with none."""
    size = F.col("p_size") % 3
    given = F.when(size == 0, F.concat("p_name", F.lit(" 采购看 链接拍 red"))).when(size == 1, F.concat(F.lit("链接拍"), "p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.truncate_operational(given).alias("name"))


@query("""select p_partkey, '折叠椅' || p_partkey || ' ' || p_name || ' 折 叠 椅 折叠 叠椅 ' || p_partkey as indexed from part""")
def indexed_names(spark, sf_dir):
    values = F.array(F.concat(F.lit("折叠椅"), F.col("p_partkey").cast("string")), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", tx.index_text(values).alias("indexed"))


@query(r"""with w as (select doc_id, list_filter(string_split_regex(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '') as w from documents)
select doc_id, cast(len(w) as bigint) as n_words, sha256(array_to_string(w, ' ')) as words_sha256 from w""")
def folded_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.fold_accents(F.coalesce("text", F.lit(""))).alias("folded"))
    w = tx.index_words(F.col("folded"))
    return d.select("doc_id", F.size(w).cast("long").alias("n_words"), F.sha2(F.array_join(w, " "), 256).alias("words_sha256"))


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 4 <> 0 then p_type end, case when p_size % 2 <> 0 then p_brand end], lambda x: x is not null), '>') as path,
 case when p_size % 2 <> 0 then p_brand when p_size % 4 <> 0 then p_type else 'catalog' end as leaf from part""")
def category_columns(spark, sf_dir):
    size = F.col("p_size")
    levels = [F.when(size % 4 == 0, " ").otherwise(F.col("p_type")), F.when(size % 2 == 0, "N/A").otherwise(F.col("p_brand")), F.when(size % 5 == 0, "未知").otherwise(""), F.lit("")]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.category_path(levels), ">").alias("path"), tx.leaf_category(levels, F.lit("catalog")).alias("leaf"))


@query("""select n_nationkey, case n_nationkey % 4 when 0 then lower(n_name) || '（' || n_name || '）' when 1 then n_name when 2 then lower(n_name) else '' end as question from nation""")
def role_questions(spark, sf_dir):
    key = F.col("n_nationkey") % 4
    cn = F.when(key < 2, F.concat(F.lit(" "), "n_name")).when(key == 2, " ")
    en = F.when((key == 0) | (key == 2), F.lower("n_name")).when(key == 1, "")
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.question_name(cn, en).alias("question"))


@query(r"""select page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) as slug,
 regexp_replace(regexp_replace('. ' || url || ' .', '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') as filename from pages""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"), tx.safe_filename(F.concat(F.lit(". "), "url", F.lit(" ."))).alias("filename"))


@query("""select n_nationkey, case n_nationkey % 5 when 0 then 'PH' when 1 then 'TH' when 2 then 'VN' when 3 then 'MY' end as code from nation""")
def country_codes(spark, sf_dir):
    key = F.col("n_nationkey") % 5
    raw = F.when(key == 0, " ph ").when(key == 1, "泰国").when(key == 2, "Vn").when(key == 3, " 马来西亚 ").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.country_code(raw).alias("code"))


@query("""select l_orderkey, l_linenumber, cast(cast(l_quantity as bigint) as varchar) as quantity, case when l_discount = floor(l_discount) then cast(cast(l_discount as bigint) as varchar) else cast(l_discount as varchar) end as discount from lineitem""")
def cell_texts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.cell_text(F.col("l_quantity")).alias("quantity"), tx.cell_text(F.col("l_discount")).alias("discount"))


@query("""select c_custkey, concat_ws(chr(10), '名称：' || c_name, case when c_acctbal >= 0 then '细分：' || c_mktsegment end) as card, c_name || chr(10) || c_mktsegment as listed,
 cast(greatest(1, ceil(length(c_name) / 10.0)) + greatest(1, ceil((6 + length(c_mktsegment)) / 10.0)) as bigint) as height from customer""")
def report_cells(spark, sf_dir):
    """Labelled fields, distinct lines, and the lines that a cell of ten columns takes."""
    card = tx.labelled({"名称": F.col("c_name"), "细分": F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment"))})
    listed = tx.distinct_lines(F.array("c_name", F.concat(F.lit(" "), "c_name"), F.lit(""), "c_mktsegment"))
    height = tx.row_lines(F.concat("c_name", F.lit("\n折叠椅"), "c_mktsegment"), 10)
    return table(spark, sf_dir, "customer").select("c_custkey", card.alias("card"), listed.alias("listed"), height.alias("height"))


@query("""select p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","note":null,"size":' || p_size || '}') as hash from part""")
def canonical_hashes(spark, sf_dir):
    fields = {"size": F.col("p_size"), "name": F.col("p_name"), "note": F.lit(None).cast("string"), "brand": F.col("p_brand")}
    return table(spark, sf_dir, "part").select("p_partkey", sc.canonical_hash(fields).alias("hash"))


@query("""with h as (select p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('main:' || p_partkey)) as s from part)
select p_partkey, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(s, 17, 1)), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) as point_id from h""")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sc.point_id(F.concat(F.lit("main:"), F.col("p_partkey").cast("string"))).alias("point_id"))


@query("""select vec_id, vec_id % 3 = 2 as valid, vec_id % 2 = 0 as usable from embeddings""")
def vector_checks(spark, sf_dir):
    """Vectors that are one short, that hold a NaN, and whole ones; and, where zeros are not allowed, vectors of zeros."""
    e, short = F.col("embedding"), F.slice("embedding", 1, 63)
    key = F.col("vec_id") % 3
    v = F.when(key == 0, short).when(key == 1, F.concat(short, F.array(F.lit(float("nan")).cast("float")))).otherwise(e)
    zeros = F.when(F.col("vec_id") % 2 == 1, F.transform(e, lambda x: F.lit(0.0).cast("float"))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", sc.valid_vector(v, 64).alias("valid"), sc.valid_vector(zeros, 64, allow_zero=False).alias("usable"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as utc, value < 50 as sound from events""")
def iso_times(spark, sf_dir):
    utc = sc.iso_utc(F.col("ts"))
    given = F.when(F.col("value") < 50, utc).when(F.col("value") < 100, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", utc.alias("utc"), sc.is_iso_utc(given).alias("sound"))


@query("""with a as (select conv_id, list(turn order by turn) as a from conversations group by conv_id)
select conv_id, array_to_string(case when len(a) <= 3 then a else list_transform(range(0, 3), lambda i: a[cast(floor(i * len(a) / 3.0) as bigint) + 1]) end, ',') as turns from a""")
def spread_turns(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("a"))
    return g.select("conv_id", F.array_join(sc.every_nth(F.col("a"), 3).cast("array<string>"), ",").alias("turns"))


@query("""select conv_id, turn, cast(floor(turn / 2.0) as bigint) as batch from conversations""")
def turn_batches(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sc.batch_number(F.col("turn") + 1, 2).alias("batch"))


@query(f"with {CANDIDATES} select scene, main_sku, cast(floor((rank - 1) / 10.0) as bigint) as batch from cand")
def question_batches(spark, sf_dir):
    return rerank.question_batches(candidates(spark, sf_dir).withColumn("role_place", F.lit(0)), 10).select("scene", "main_sku", "batch")


@query("""with pr as (select 'P' || p_partkey as doc, lower(p_name) as cn, lower(p_name || ' ' || p_type) as en from part),
tok as (select doc, 'cn' as field, unnest(regexp_extract_all(cn, '[a-z0-9]+')) as token from pr union all select doc, 'en', unnest(regexp_extract_all(en, '[a-z0-9]+')) from pr),
post as (select doc, field, token, count(*) as tf from tok group by all), len as (select doc, sum(tf) as size from post group by doc), stats as (select count(*) as n, avg(size) as mean from len),
ask as (select 'cn' as field, p_name as query, unnest(list_distinct(regexp_extract_all(p_name, '[A-Za-z0-9]+'))) as tok from (select distinct p_name from part)
 union all select 'en', p_type, unnest(list_distinct(regexp_extract_all(p_type, '[A-Za-z0-9]+'))) from (select distinct p_type from part)),
df as (select field, token, count(*) as df from post group by all),
idf as (select field, token, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf from df, stats),
sc as (select a.field as language, a.query, p.doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) as score from ask a join post p on p.field = a.field and p.token = lower(a.tok) join idf i on i.field = p.field and i.token = p.token join len on len.doc = p.doc, stats group by a.field, a.query, p.doc)
select language, query, doc, round(score, 6) as score, cast(rank as integer) as rank from (select *, row_number() over (partition by language, query order by score desc, doc) as rank from sc) where rank <= 30""")
def bilingual_keyword_search(spark, sf_dir):
    """Every name asked in the Chinese field, every type in the English one, of one index over both."""
    p = table(spark, sf_dir, "part")
    products = p.select(F.concat(F.lit("P"), "p_partkey").alias("main_sku"), F.col("p_name").alias("standard_name_cn"), F.concat_ws(" ", "p_name", "p_type").alias("standard_name_en"))
    docs, fields = bilingual_fields(products)
    index = kept_index(spark, "products", f"{sf_dir}/part.parquet", docs, "main_sku", fields)
    out = None
    for language, column in (("cn", "p_name"), ("en", "p_type")):
        terms = p.select(F.col(column).alias("query_id"), F.col(column).alias("query")).distinct()
        found = index.search(query_tokens(terms), 30, weights={language: 1.0})
        found = found.select(F.lit(language).alias("language"), F.col("query_id").alias("query"), "doc", F.round("score", 6).alias("score"), "rank")
        out = found if out is None else out.unionByName(found)
    return out
