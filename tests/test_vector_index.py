"""Vector search in blocks and by lists against brute force: ties, zero vectors, scopes, few and many queries."""

import numpy as np
import pytest

from lodestock.operators import search, vector_index
from lodestock.operators.vector_index import VectorIndex


def frame(spark, values, key="doc"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], f"{key} long, vector array<float>")


def brute(values, asked, k, metric="cosine", scope=None):
    v, q = np.float32(values).astype(float), np.float32(asked).astype(float)
    if metric != "dot":
        v, q = search.unit_rows(v), search.unit_rows(q)
    s = q @ v.T
    s = np.round(np.clip((s + 1) / 2, 0, 1) if metric == "unit" else s, 9)
    out = []
    for i, row in enumerate(s):
        docs = [d for d in range(len(v)) if scope is None or d in scope]
        out += [(i, d, r) for r, d in enumerate(sorted(docs, key=lambda d: (-row[d], d))[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["doc"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (6, 8))[rng.integers(0, 6, 240)] + rng.normal(0, 0.15, (240, 8)), np.zeros((3, 8)), np.ones((5, 8)), np.ones((5, 8)) * 2])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("metric", ["cosine", "unit", "dot"])
def test_blocks(spark, values, monkeypatch, metric):
    """Queries beyond a block are dealt out with the vectors; the answer is that of one block."""
    asked = values[::5]
    want = brute(values, asked, 7, metric)
    one = search.vector_search(frame(spark, values), frame(spark, asked, "query_id"), 7, metric=metric)
    assert rows(one) == want
    for name, n in (("QUERY_BLOCK", 9), ("VECTOR_BLOCK", 40), ("SCORES", 100)):
        monkeypatch.setattr(search, name, n)
    many = search.vector_search(frame(spark, values), frame(spark, asked, "query_id"), 7, metric=metric)
    assert rows(many) == want
    assert search.vector_search(frame(spark, values).limit(0), frame(spark, asked, "query_id"), 7).count() == 0
    assert search.vector_search(frame(spark, values), frame(spark, asked, "query_id").limit(0), 7).count() == 0


def built(spark, values, lists=None):
    t = vector_index.index_tables(frame(spark, values), lists)
    return VectorIndex(*(t[n].cache() for n in ("vectors", "lists", "probes")))


@pytest.mark.parametrize("metric", ["cosine", "unit"])
def test_exact_by_bounds(spark, values, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 16)  # lists in several chunks
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 20)
    index, asked = built(spark, values, 12), values[::4]
    for probes in (1, 4):
        assert rows(index.search(frame(spark, asked, "query_id"), 9, probes=probes, exact=True, metric=metric)) == brute(values, asked, 9, metric)
    scope = set(range(0, len(values), 3))
    got = index.search(frame(spark, asked, "query_id"), 9, exact=True, metric=metric, scope=spark.createDataFrame([(d,) for d in scope], "doc long"))
    assert rows(got) == brute(values, asked, 9, metric, scope)
    assert index.vectors.groupBy("list", "chunk").count().agg({"count": "max"}).first()[0] < 60 and index.vectors.count() == len(values)


def test_recall(spark, values):
    """In clusters a few lists do; every vector is indexed; the report counts what is missed."""
    index, q = built(spark, values), frame(spark, values[::4], "query_id")
    exact = search.vector_search(frame(spark, values), q, 5)
    r = vector_index.recall(index.search(q, 5), exact).first()
    assert r["recall"] >= 0.9 and r["queries"] == len(values[::4]) and r["wanted"] == 5 * r["queries"]
    assert index.probes.first()[0] < index.lists.count()
    worse = vector_index.recall(index.search(q, 5, probes=1).where("rank < 3"), exact).first()
    assert worse["recall"] <= 0.4


def test_few_or_no_vectors(spark):
    for values in (np.zeros((0, 4)), np.zeros((3, 4)), np.eye(4)):
        t = vector_index.index_tables(frame(spark, values))
        index = VectorIndex(t["vectors"], t["lists"], t["probes"])
        got = index.search(frame(spark, np.eye(4)[:2], "query_id"), 3, exact=True)
        assert rows(got) == brute(values.reshape(-1, 4), np.eye(4)[:2], 3)


def test_distances_hold_a_bounded_number_of_scores(monkeypatch):
    """Slices of rows against centroids, whatever their number, and the same distances as at once."""
    rng = np.random.default_rng(3)
    rows, centres, most = rng.normal(size=(500, 8)), rng.normal(size=(90, 8)), []
    d = vector_index.gaps(rows, centres)
    plain = vector_index.gaps
    monkeypatch.setattr(vector_index, "SCORES", 1000)
    monkeypatch.setattr(vector_index, "gaps", lambda r, c: (most.append(len(r) * len(c)), plain(r, c))[1])
    least, of = vector_index.distances(rows, centres)
    assert max(most) <= 1000 and (of == d.argmin(1)).all() and np.allclose(least, d.min(1))
