"""An inverted-file vector index: vectors in lists round centroids, searched by the nearest lists, or exactly by the triangle inequality.

Centroids are fitted on a bounded sample, on which it is also measured how many lists hold nearly all near neighbours; every vector is indexed. All vectors are brought to unit length, so that nearer means a higher
cosine: distance^2 = 2 - 2 cos. A list keeps its radius, the largest distance of its vectors from the centroid. After a query's nearest lists
are searched, its k-th best distance rules out every list whose centroid is farther than that distance plus the radius; an exact
search reads those that are left, and only those. Vectors of length zero, which have no direction, are a list that is always searched.

Lists are dealt in chunks of a bounded number of vectors and queries in blocks, so that a list of any size, and any number of queries, is
searched by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import QUERY_BLOCK, SCORES, VECTOR_BLOCK, best_of_blocks, matrix, top_k, unit_rows

#: Vectors that centroids are fitted on, and numbers that the sample may hold (32 MB); rounds of fitting; most lists.
SAMPLE, SAMPLE_NUMBERS, ROUNDS, MOST_LISTS = 50_000, 1 << 22, 12, 4096
#: The list of vectors without direction.
NOWHERE = -1
#: By how much a list's bound is loosened, for rounding of scores to nine places.
SLACK = 1e-4


def fitted(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct sample rows; one that loses all its rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    sample = np.unique(unit_rows(sample), axis=0)
    sample = sample[np.abs(sample).sum(1) > 0]
    centres = sample[rng.permutation(len(sample))[:lists]]
    for _ in range(ROUNDS if len(sample) > lists else 0):
        far, of = distances(sample, centres)
        for c in range(len(centres)):
            mine = sample[of == c]
            if len(mine):
                centres[c] = mine.mean(0)
            else:
                worst = int(far.argmax())
                centres[c], far[worst] = sample[worst], 0
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distance to its nearest centroid, and which that is; SCORES numbers are held at a time."""
    if not len(centres):
        return np.zeros(len(rows)), np.full(len(rows), NOWHERE)
    least, of, step = np.zeros(len(rows)), np.zeros(len(rows), np.int64), max(1, SCORES // len(centres))
    for a in range(0, len(rows), step):
        d = gaps(rows[a : a + step], centres)
        of[a : a + step], least[a : a + step] = d.argmin(1), d.min(1)
    return least, of


def gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros((len(rows), 0))
    return np.sqrt(np.maximum((rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T, 0))


def calibrated(sample: np.ndarray, centres: np.ndarray, k: int = 10, target: float = 0.95, queries: int = 256) -> int:
    """How many lists hold `target` of the k nearest other sample rows of the first `queries` rows."""
    rows = unit_rows(sample)
    rows = rows[rows.any(1)]
    if len(rows) < 2 or not len(centres):
        return 1
    asked = rows[:queries]
    scores = asked @ rows.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
    place = np.argsort(np.argsort(gaps(asked, centres), axis=1, kind="stable"), axis=1)
    _, of = distances(rows, centres)
    ranks = np.sort(np.take_along_axis(place, of[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def _placed(centres: np.ndarray):
    def place(batches):
        for r in batches:
            rows = unit_rows(matrix(r.column(1))) if r.num_rows else np.zeros((0, centres.shape[1] if centres.ndim > 1 else 0))
            far, of = distances(rows, centres) if r.num_rows else (np.zeros(0), np.zeros(0, np.int64))
            zero = ~rows.any(1) if r.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(np.where(zero, NOWHERE, of).astype(np.int32)), pa.array(np.where(zero, 0.0, far))], names=["doc", "vector", "list", "distance"])

    return place


def index_tables(vectors: DataFrame, lists: int | None = None) -> dict[str, DataFrame]:
    """The tables of an index over vectors (doc, vector; keys unique): vectors (doc, vector, chunk, list), lists (list, centre, radius, size), at most MOST_LISTS and one, and probes, a row."""
    vectors = vectors.select("doc", "vector")
    first = vectors.first()
    width = len(first["vector"]) if first else 0
    size = vectors.count()
    n = lists or max(4, min(MOST_LISTS, round(size**0.5)))
    rows = min(SAMPLE, SAMPLE_NUMBERS // max(width, 1))
    sample = matrix(vectors.orderBy(F.xxhash64("doc"), "doc").limit(rows).select("vector").toArrow()["vector"]) if first else np.zeros((0, 0))
    centres = fitted(sample, n) if first else sample
    kind = vectors.schema["doc"].dataType.simpleString()
    placed = vectors.mapInArrow(_placed(centres), f"doc {kind}, vector {vectors.schema['vector'].dataType.simpleString()}, list int, distance double")
    spark = vectors.sparkSession
    told = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)] + [(NOWHERE, [])], "list int, centre array<double>")
    sizes = placed.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("size"))
    listed = told.join(sizes, "list", "left").select("list", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("size", F.lit(0)).alias("size"))
    # the chunks of a list are as many as its size asks for, and a row's is by its key
    chunks = sizes.select(F.col("list").alias("of"), F.ceil(F.col("size") / VECTOR_BLOCK).alias("chunks"))
    dealt = placed.join(F.broadcast(chunks), F.col("list") == F.col("of")).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")))  # a row a list
    return {"vectors": dealt.select("doc", "vector", "chunk", "list").repartition("list", "chunk"), "lists": listed, "probes": spark.createDataFrame([(calibrated(sample, centres),)], "probes int")}


def _probes(centres: np.ndarray, radius: np.ndarray, numbers: np.ndarray, probes: int, worst: bool):
    """(query_id, vector, list) of the lists to search: the nearest `probes`, or with `worst` (a query's k-th distance so far) those that it does not rule out, the nearest left out."""

    step = max(1, SCORES // 4 // max(len(centres), 1))  # a slice's vectors go out once for each of its lists

    def probe(batches):
        for r in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
            rows = unit_rows(matrix(r.column(1)))
            d = gaps(rows, centres)
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :probes], True, axis=1)
            if worst:
                limit = np.asarray(r.column(2), dtype=np.float64)[:, None]
                near = ~near & ((d - radius[None] <= limit + SLACK) | ~rows.any(1)[:, None])
            q, c = np.nonzero(near)
            if not worst:  # and the vectors without direction
                q, c = np.concatenate([q, np.arange(len(rows))]), np.concatenate([c, np.full(len(rows), len(numbers))])
            yield pa.RecordBatch.from_arrays([r.column(0).take(pa.array(q)), r.column(1).take(pa.array(q)), pa.array(np.append(numbers, NOWHERE)[c].astype(np.int32))], names=["query_id", "vector", "list"])

    return probe


@dataclass(frozen=True)
class VectorIndex:
    """An index as read from its version: vectors, lists, and the number of lists that its calibration chose."""

    vectors: DataFrame
    lists: DataFrame
    probes: DataFrame

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False, metric: str = "cosine", scope: DataFrame | None = None) -> DataFrame:
        """(query_id, doc, score, rank) by cosine, or unit ((cos+1)/2). queries: (query_id, vector). scope (doc) restricts what is ranked.

        Without `exact`, the `probes` nearest lists are searched (as many as held 0.95 of the sample's neighbours, if None) and the result may miss some; `recall` tells how many.
        """
        if probes is None:
            probes = 4 if exact else self.probes.first()[0]
        told = [r for r in self.lists.collect() if r["list"] != NOWHERE]  # at most MOST_LISTS
        numbers, radius = np.array([r["list"] for r in told], dtype=np.int64), np.array([r["radius"] for r in told])
        centres = np.array([r["centre"] for r in told], dtype=np.float64).reshape(len(told), -1) if told else np.zeros((0, 0))
        queries = queries.select("query_id", "vector")
        found = self.vectors if scope is None else self.vectors.join(scope.select("doc").distinct(), "doc", "left_semi")
        kind = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "vector")) + ", list int"
        blocks = -(-queries.count() // QUERY_BLOCK) or 1

        def best(probed: DataFrame) -> DataFrame:
            # the chunks of a list, and the blocks of queries, meet each other
            chunks = self.lists.select("list", F.ceil(F.col("size") / VECTOR_BLOCK).alias("chunks"))
            asked = probed.join(F.broadcast(chunks), "list").where("chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
            offered = found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
            return best_of_blocks(asked.select("query_id", "vector", "list", "chunk", "block"), offered.select("doc", "vector", "list", "chunk", "block"), ["list", "chunk", "block"], k, metric)

        near = best(queries.mapInArrow(_probes(centres, radius, numbers, probes, False), kind))
        if exact:
            cosine = F.col("score") if metric == "cosine" else 2 * F.col("score") - 1
            kth = top_k(near.withColumn("score", F.round("score", 9)), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min(cosine).alias("least"))
            limit = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)))).otherwise(F.lit(4.0))  # no two unit vectors are farther apart than 2
            open_ = queries.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce(limit, F.lit(4.0)).alias("limit"))
            near = near.unionByName(best(open_.mapInArrow(_probes(centres, radius, numbers, probes, True), kind)))
        return top_k(near.withColumn("score", F.round("score", 9)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, wanted, found, recall. Both: (query_id, doc, ...), the k best of each query."""
    hits = exact.select("query_id", "doc").join(found.select("query_id", "doc", F.lit(1).alias("hit")), ["query_id", "doc"], "left")
    g = hits.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")))
