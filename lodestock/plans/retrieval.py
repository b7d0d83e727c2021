"""Searches as whole plans: a store's roles over four channels, and batches of requests with and without a country's scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fusion, search, stock
from ..operators.inverted import Inverted, index_tables
from .params import SearchParams

CHANNEL_LIMIT, GLOBAL_LIMIT = 100, 400
LANGUAGES, SEPARATOR = ("cn", "en"), "\u001f"


def bilingual_fields(products: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Products and their tokens in the fields cn and en. products: (main_sku, standard_name_cn, standard_name_en)."""
    p = products.select("main_sku", *[tx.normalize_compare(F.col(f"standard_name_{g}")).alias(g) for g in LANGUAGES])
    p = tx.with_folded(p.select("main_sku", *[tx.index_text(F.array(g)).alias(g) for g in LANGUAGES]), list(LANGUAGES))
    return p, {g: tx.index_words(F.col(g)) for g in LANGUAGES}


def bilingual_index(products: DataFrame) -> Inverted:
    """The index of products' names, not stored."""
    docs, fields = bilingual_fields(products)
    tables = index_tables(docs, "main_sku", fields)
    return Inverted(tables["postings"], tables["lengths"])


def query_tokens(terms: DataFrame) -> DataFrame:
    """(query_id, token): folded tokens of each term's text; a token in two cases counts twice. terms: (query_id, query)."""
    t = terms.withColumn("n", tx.normalize_compare(F.col("query"))).select("query_id", F.explode(tx.keyword_tokens(F.col("n"))).alias("token"))
    return t.select("query_id", tx.fold_accents(F.col("token")).alias("token"))


def named_terms(terms: DataFrame) -> DataFrame:
    """(query_id, language, query): each distinct term of each language once."""
    return terms.select("language", "query").distinct().withColumn("query_id", F.concat_ws(SEPARATOR, "language", "query"))


def keyword_channels(once: DataFrame, index: Inverted, limit: int) -> DataFrame:
    """(query_id, doc, rank): every term in its language's field, all terms in one read of their postings."""
    asked = query_tokens(once).withColumn("field", F.substring_index("query_id", SEPARATOR, 1))
    return index.search(asked, limit, weights=dict.fromkeys(LANGUAGES, 1.0)).select("query_id", "doc", "rank")


def channel_hits(terms: DataFrame, index: Inverted, vectors: DataFrame, term_vectors: DataFrame, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """(role_id, channel, query, weight, doc, place) of all terms in all four channels; each distinct term is searched once.

    terms: (role_id, language, query, weight); vectors: (language, main_sku, vector); term_vectors: (language, query, vector).
    """
    once = named_terms(terms)
    found = keyword_channels(once, index, limit).withColumn("kind", F.lit("keyword"))
    for g in LANGUAGES:
        asked = term_vectors.where(F.col("language") == g).join(once, ["language", "query"]).select("query_id", "vector")
        near = search.vector_search(vectors.where(F.col("language") == g).select(F.col("main_sku").alias("doc"), "vector"), asked, limit, metric="dot")
        found = found.unionByName(near.select("query_id", "doc", "rank", F.lit("vector").alias("kind")))
    mine = terms.select("role_id", "language", "query", "weight", F.concat_ws(SEPARATOR, "language", "query").alias("query_id"))
    return mine.join(found, "query_id").select("role_id", F.concat_ws("_", "language", "kind").alias("channel"), "query", "weight", "doc", F.col("rank").alias("place"))


def retrieve(roles: DataFrame, products: DataFrame, vectors: DataFrame, term_vectors: DataFrame, country_stock: DataFrame | None, params: SearchParams, *, weighted: bool = False, index: Inverted | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, status) of every role in one plan. roles as fusion.role_terms takes them; country_stock: (main_sku, quantity), None if it could not be read.

    Unknown stock never counts as stock: with the in-stock filter it is an error.
    """
    if country_stock is None and params.stock_filter == "in_stock":
        raise RuntimeError("stock could not be read, so nothing can be shown as in stock")
    terms = fusion.role_terms(roles)
    if not weighted:
        terms = terms.withColumn("weight", F.lit(fusion.PRIMARY))
    fused = fusion.fuse(channel_hits(terms, index or bilingual_index(products), vectors, term_vectors), products=products, limit=GLOBAL_LIMIT)
    names = products.select("main_sku", "standard_name_cn", "standard_name_en")
    found = fused.withColumnRenamed("doc", "main_sku").withColumn("rrf_score", F.round("score", 8)).drop("evidence", "score").join(names, "main_sku")
    marked = stock.annotate(found, country_stock)
    kept = stock.cut(marked, params.recall_limit, in_stock_only=country_stock is not None and params.stock_filter == "in_stock")
    return kept, stock.match_status(roles, found, kept)


def both_scopes(hits, in_country: DataFrame, documents: DataFrame, limit: int, platform: Column | None = None) -> DataFrame:
    """A request's global and in-country runs: `hits(scope)` gives channel hits with a scope (doc) or None. Adds scope; each family once, the global run first."""
    runs = [("global", hits(None)), ("country", hits(in_country))]
    out = None
    for place, (name, h) in enumerate(runs):
        r = fusion.hybrid_search(h, documents, limit, platform).withColumn("scope", F.lit(name)).withColumn("scope_place", F.lit(place))
        out = r if out is None else out.unionByName(r)
    return out


def distinct_families(scoped: DataFrame) -> DataFrame:
    """(role_id, doc) of both runs, each once, in order of the run, then of rank."""
    return scoped.groupBy("role_id", "doc").agg(F.min(F.struct("scope_place", "rank")).alias("first"))
