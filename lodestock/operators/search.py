"""Keyword and vector search of many queries in one plan, over posting and vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# BM25's constants, the floor of a token's weight, and the weights of the three indexed fields.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELD_WEIGHTS = {"cn_names": 8.0, "categories": 4.0, "en_aliases": 1.0}
#: Queries that go to the tasks as one matrix, and the size of blocks of more; vectors of a block; scores that a task holds at a time.
QUERY_BLOCK, VECTOR_BLOCK, SCORES = 4096, 65_536, 1 << 20
#: Up to this many query tokens (some MB) are broadcast to the postings; more are joined by shuffle.
MOST_TOKENS = 100_000


def postings(docs: DataFrame, key: str, fields: dict[str, Column], *, tokens: DataFrame | None = None) -> DataFrame:
    """(doc, field, token, tf): `fields` maps a field to its array of tokens. With `tokens` (token), their postings only, filtered before anything is shuffled."""
    flat = None
    for field, array in fields.items():  # a scan a field, each of its own column
        part = docs.select(F.col(key).alias("doc"), F.lit(field).alias("field"), F.explode(array).alias("token"))
        flat = part if flat is None else flat.unionByName(part)
    if tokens is not None:
        asked = tokens.select("token").distinct()
        few = asked.limit(MOST_TOKENS + 1).count() <= MOST_TOKENS
        flat = flat.join(F.broadcast(asked) if few else asked, "token", "left_semi")
    return flat.groupBy("doc", "field", "token").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(doc, size): tokens of all indexed fields, 0 for a document without any."""
    size = F.lit(0)
    for tokens in fields.values():
        size = size + F.coalesce(F.size(tokens), F.lit(0))
    return docs.select(F.col(key).alias("doc"), size.cast("long").alias("size"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: documents, mean_size."""
    return lengths.agg(F.count("*").alias("documents"), F.avg("size").alias("mean_size"))


def ordered_sum(values: Column) -> Column:
    """Sum of an array of (key, value) in the order of the key, so that it doesn't depend on the plan."""
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda s, x: s + x["value"])


def top_k(scored: DataFrame, k: int, *, by: tuple[str, ...] = ("query_id",), score: str = "score", key: str = "doc") -> DataFrame:
    """The k best of each query, ties by key; adds rank from 1. Only k rows a task and query are shuffled."""
    w = W.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_search(posts: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, *, weights: dict[str, float] = FIELD_WEIGHTS, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, rank) by BM25 over weighted fields. queries: (query_id, token) with a row for each distinct query token, folded.

    Only `weights`' fields are matched, but a document's size counts all of them. `scope` (doc) restricts what is ranked, not the
    statistics. Postings meet the query's tokens first; where they are made for one search, give the tokens to `postings`.
    """
    asked = queries.groupBy("query_id", "token").agg(F.count("*").alias("times"))
    tokens = queries.select("token").distinct()
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    found = posts.where(F.col("field").isin(*weights)).join(tokens, "token", "left_semi")
    per_doc = found.groupBy("token", "doc").agg(F.sum(F.element_at(weight, F.col("field")) * F.col("tf")).alias("f"))
    known = per_doc.groupBy("token").agg(F.count("*").alias("n"))
    stats = corpus_stats(lengths)
    raw = F.ln((F.col("documents") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = known.crossJoin(F.broadcast(stats)).select("token", F.when(raw > 0, raw).otherwise(LEAST_IDF).alias("idf"), "mean_size")  # one row of statistics
    if scope is not None:
        per_doc = per_doc.join(scope.select("doc").distinct(), "doc", "left_semi")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    parts = per_doc.join(idf, "token").join(lengths, "doc").select("token", "doc", part.alias("part"))
    scored = parts.join(asked, "token").groupBy("query_id", "doc").agg(ordered_sum(F.collect_list(F.struct(F.col("token").alias("key"), (F.col("part") * F.col("times")).alias("value")))).alias("exact"))
    return top_k(scored.select("query_id", "doc", F.round("exact", 9).alias("score")), k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of equally long lists of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def nearest(asked: np.ndarray, values: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows and of all that tie with the last of them, so that ties are settled by key later."""
    if metric != "dot":
        asked, values = unit_rows(asked), unit_rows(values)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(asked) or not len(values):
        return out[0]
    step = max(1, SCORES // len(values))
    for a in range(0, len(asked), step):
        scores = asked[a : a + step] @ values.T
        if metric == "unit":
            scores = np.clip((scores + 1) / 2, 0, 1)
        keep = np.round(scores, 9)
        if scores.shape[1] > k:
            q, d = np.nonzero(keep >= -np.partition(-keep, k - 1, axis=1)[:, k - 1 : k])
        else:
            q, d = (x.ravel() for x in np.indices(scores.shape))
        out.append((q + a, d, scores[q, d]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _kinds(vectors: DataFrame, queries: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, doc {kind(vectors, 'doc')}, score double"


def _of_block(ids: pa.ChunkedArray, asked: np.ndarray, k: int, metric: str):
    ids = ids.combine_chunks()

    def scan(batches):
        for r in batches:
            if r.num_rows and len(ids):
                q, d, s = nearest(asked, matrix(r.column(1)), k, metric)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), r.column(0).take(pa.array(d)), pa.array(s)], names=["query_id", "doc", "score"])

    return scan


def _of_blocks(k: int, metric: str):
    def join(asked: pa.Table, found: pa.Table) -> pa.Table:
        q, d, s = nearest(matrix(asked["vector"]), matrix(found["vector"]), k, metric)
        return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "doc": found["doc"].take(pa.array(d)), "score": pa.array(s)})

    return join


def best_of_blocks(queries: DataFrame, vectors: DataFrame, on: list[str], k: int, metric: str) -> DataFrame:
    """(query_id, doc, score): candidates for the k best, block against block. Both sides carry the block's key `on`; a block of either side fits a task."""
    return queries.groupBy(*on).cogroup(vectors.groupBy(*on)).applyInArrow(_of_blocks(k, metric), _kinds(vectors, queries))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", scope: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, rank), exact. vectors: (doc, vector); queries: (query_id, vector); metric: cosine, unit ((cos+1)/2) or dot. Keys are unique.

    Up to QUERY_BLOCK queries go to the tasks as one matrix, and vectors are not moved. More are dealt into blocks, as are the vectors;
    each block of queries meets each block of vectors in a task of its own, which hands on k rows a query. The driver never holds more than one block of queries.
    """
    if scope is not None:
        vectors = vectors.join(scope.select("doc").distinct(), "doc", "left_semi")
    vectors, queries = vectors.select("doc", "vector"), queries.select("query_id", "vector")
    head = queries.limit(QUERY_BLOCK + 1).toArrow()
    if head.num_rows <= QUERY_BLOCK:
        found = vectors.mapInArrow(_of_block(head["query_id"], matrix(head["vector"]), k, metric), _kinds(vectors, queries))
    else:
        blocks = [-(-d.count() // size) or 1 for d, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK))]
        dealt = lambda d, key, own, other, n, m: d.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        found = best_of_blocks(dealt(queries, "query_id", "qb", "vb", *blocks), dealt(vectors, "doc", "vb", "qb", *reversed(blocks)), ["qb", "vb"], k, metric)
    return top_k(found.withColumn("score", F.round("score", 9)), k)


def embedding_intersection(embeddings: DataFrame) -> DataFrame:
    """(main_sku, vectors by language): SKUs that have a vector in every language, one model a language."""
    models = embeddings.groupBy("language").agg(F.countDistinct("model_key").alias("models"))
    checked = embeddings.join(F.broadcast(models.where("models = 1").select("language")), "language")  # a row a language
    n = embeddings.select("language").distinct().count()
    return checked.groupBy("main_sku").agg(F.map_from_entries(F.collect_list(F.struct("language", "vector"))).alias("vectors")).where(F.size("vectors") == n)


def split_cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of `wanted` (cache_key, ...) with their cached vector, and those that must be embedded."""
    return wanted.join(cache.select("cache_key", "vector"), "cache_key"), wanted.join(cache.select("cache_key"), "cache_key", "left_anti")


def index_diff(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """(main_sku, change): changed, removed or reused, by text. Both: (main_sku, text)."""
    j = now.withColumnRenamed("text", "new_text").join(indexed.withColumnRenamed("text", "old_text"), "main_sku", "full_outer")
    change = F.when(F.col("new_text").isNull(), "removed").when(F.col("new_text").eqNullSafe(F.col("old_text")), "reused").otherwise("changed")
    return j.select("main_sku", change.alias("change"))
