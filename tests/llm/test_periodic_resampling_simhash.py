"""Periodic runs, importance resampling and SimHash against brute force, on odd rows, hostile texts and clashing names."""

import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestock.llm import periodic, resampling, simhash

from ..test_queries import TABLES
from .test_llm_operators import ODD, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- periodic runs -----------------------------------------------------------------------------------------------------


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def numbered(many):
    ids, known = [np.zeros(0, np.int64)], 0
    for words in many:
        number = {}
        ids.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) + known)
        known += len(number)
    return np.concatenate(ids), np.cumsum([0] + [len(w) for w in many])


def repetitive(rng):
    n, k = rng.randrange(160), rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 4 else 0):
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 2 + 1))
        for i in range(a, min(n, a + rng.randrange(1, 8) * p)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("light, short, close", [(64, 1 << 13, 16), (1, 1 << 13, 16), (1, 0, 0), (64, 0, 0)])
def test_runs(monkeypatch, light, short, close):
    """With every word counted by FFT or by pairs, and every lag scanned word by word or by anchors."""
    for name, value in (("LIGHT", light), ("SHORT", short), ("CLOSE", close)):
        monkeypatch.setattr(periodic, name, value)
    rng = random.Random(light + short)
    for _ in range(150):
        many = [repetitive(rng) for _ in range(rng.choice([1, 1, 4]))]
        assert periodic.runs(*numbered(many)) == [brute_runs(w) for w in many]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_any_runs(words):
    assert periodic.runs(*numbered([words])) == [brute_runs(words)]


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and words:
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(words), len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def test_op11(spark, sf):
    rows = [(i, t) for i, t in ODD if i != 9] + [(i, prose(i, 60)) for i in range(100, 190)] + [(200, "a b c " * 50 + prose(5)), (201, "tail " * 30)]
    got = sorted(map(tuple, periodic.periodic_runs(docs(spark, rows).repartition(3), plant=periodic.planted_tail).collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in rows), key=str)
    whole = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in periodic.op11_periodic_runs(spark, sf).collect()}
    assert all(got[r["doc_id"]] == brute_row(*r) for r in whole) and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_collapse(spark):
    out = {r["doc_id"]: r for r in periodic.collapse_runs(docs(spark, [(1, "x y " * 20), (2, None), (3, "plain  text")])).collect()}
    assert [(out[i]["text"], out[i]["n_runs"]) for i in (1, 2, 3)] == [("x y", 1), ("", 0), ("plain text", 0)]


@pytest.mark.parametrize("words", [[0] * 400_000, [i % 7 for i in range(300_000)], [int(b) for b in np.random.default_rng(1).integers(0, 2, 60_000)]])
def test_hostile_repetition(words):
    t = time.process_time()
    found = periodic.runs(*numbered([words]))[0]
    assert time.process_time() - t < 40 and found


# -- importance resampling ---------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text, grams=1, buckets=10_000):
    w = TERM.findall(lowered(text))
    return [zlib.crc32(" ".join(w[i : i + g]).encode()) % buckets for g in range(1, grams + 1) for i in range(len(w) - g + 1)], len(w)


@pytest.mark.parametrize("piece", [8, 50, 1 << 20])
def test_automaton(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(60):
        texts = [rng.choice([None, "", "x" * rng.randrange(200), "".join(rng.choice("aZ9é -\x00中._") for _ in range(rng.randrange(300)))]) for _ in range(rng.randrange(1, 8))]
        for grams in (1, 3):
            got, single = [[] for _ in texts], [0] * len(texts)
            for row, bucket, n in resampling.features(pa.array(["sliced away", *texts]).slice(1), resampling.Plan(grams=grams)):
                for i, b in zip(row.tolist(), bucket.tolist()):
                    got[i].append(b)
                for i in row[:n].tolist():
                    single[i] += 1
            assert [(sorted(g), n) for g, n in zip(got, single)] == [(sorted(b), n) for b, n in (brute_buckets(t, grams) for t in texts)]


def brute_resample(rows, target, percent=10):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text in rows:
        np.add.at(s, brute_buckets(text)[0], 1)
    for text in target:
        np.add.at(t, brute_buckets(text)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for place, (i, text) in enumerate(rows):
        f = brute_buckets(text)[0]
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), place])
    best = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[4]: n for n, r in enumerate(best[: percent * len(best) // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(r[4]),) for r in out), key=str)


def test_op12(spark):
    rows = [(i, prose(i % 40, 60)) for i in range(100, 300)] + ODD
    target = [prose(3), prose(4), None]
    want = brute_resample(rows, target)
    got = resampling.resample(docs(spark, rows).repartition(5), docs(spark, list(enumerate(target))))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [r for r in map(tuple, resampling.resample(docs(spark, rows), docs(spark, []), plan=resampling.Plan(percent=100)).collect()) if r[4] == 1]


def test_op12_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(map(tuple, resampling.op12_resampling(spark, sf).collect())) == sorted(con.execute(resampling.SQL).fetchall())


# -- simhash -----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = WORD.findall(lowered(text))
    g = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBé 中\n\t ", max_size=120))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode())[1] == brute_fingerprint(text)


def components(f, edges):
    root = {x: x for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in f}


def near(f):
    return [(a, b) for i, a in enumerate(f) for b in f[i + 1 :] if (a ^ b).bit_count() <= 3]


@pytest.mark.parametrize("small, crowded", [(32, 1 << 15), (2, 1 << 15), (2, 6)])
def test_lists(monkeypatch, small, crowded):
    """Lists compared side by side, by blocks, or by looking neighbours up; in batches that cut lists anywhere."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(small)
    for n in (1, 40, 250) if crowded > 6 else (12, 30):
        base, f = [rng.getrandbits(64) for _ in range(3)], set()
        for _ in range(n):
            x = rng.choice(base)
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            f.add(x)
        f = sorted(f)
        arr = np.array(f, dtype=np.uint64)
        entries = sorted((int(a), int(x)) for c in range(56) for a, x in zip(simhash.list_of(arr, c), arr))
        lists, prints = np.array([e[0] for e in entries]), np.array([e[1] for e in entries], dtype=np.uint64).view(np.int64)
        step = rng.choice([7, 100, 10**6])
        rows = [pa.RecordBatch.from_pydict({"list": lists[i : i + step], "f": prints[i : i + step]}) for i in range(0, len(lists), step)]
        edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for r in simhash._meet(rows) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges) and components(f, edges) == components(f, near(f))


def brute_simhash(rows):
    prints = {t: brute_fingerprint(t) for _, t in rows}
    f = sorted(set(prints.values()))
    root = components(f, near(f))
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    return sorted(((i, f"{prints[t]:016x}", least.get(root[prints[t]])) for i, t in rows), key=str)


def test_op13(spark, sf):
    rows = [(i, prose(i % 9, 80, edits=i % 4)) for i in range(100, 220)] + ODD + [(None, "alone and unnamed here")]
    got = simhash.simhash_components(docs(spark, rows).repartition(3)).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_simhash(rows)
    whole = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op13_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()), key=str) == brute_simhash(whole)


# -- all three ---------------------------------------------------------------------------------------------------------


def test_empty_tables_and_clashing_names(spark):
    inside = "f list a b least root v component_id bucket rank score eligible place number task before fingerprint start n_runs".split()
    rows = docs(spark, [(i, prose(i % 3, 40)) for i in range(30)] + [(None, None), (1, "")])
    frame = rows.select(*rows.columns, *[F.lit("x").alias(c) for c in inside])
    for run in (periodic.periodic_runs, periodic.collapse_runs, simhash.simhash_components, lambda d: resampling.resample(d, d)):
        assert run(rows.limit(0)).count() == 0
        assert sorted(map(str, run(rows).collect())) == sorted(map(str, run(frame).collect()))
    nulls = rows.select("doc_id", F.lit(None).cast("string").alias("text"))
    assert {tuple(r)[2:] for r in resampling.resample(nulls, nulls).select("doc_id", "score", "n_features", "weight", "rank").collect()} == {(0, 0, None)}
    assert {r["component_id"] for r in simhash.simhash_components(nulls).collect()} == {0}
