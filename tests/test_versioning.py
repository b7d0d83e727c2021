"""Versions on a shared store: one publisher wins, readers see one version, trees find what differs."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestock.plans.versioning import LEAVES, DataChangedError, GateError, LineageError, Versions
from lodestock.sources.store import BusyError, Lease, Store


@pytest.fixture
def v(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/v")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "main_sku string, n int")


def test_versions(spark, v):
    df = frame(spark, ("A", 1))
    a = v.rebuild({"source": "1"}, {"documents": df})
    assert v.rebuild({"source": "1"}, {"documents": df}) == a
    b = v.rebuild({"source": "2"}, {"documents": df.withColumn("n", F.lit(2))})
    with pytest.raises(GateError):
        v.rebuild({"source": "3"}, {"documents": df}, {"never": lambda t: t["documents"]})
    assert v.state() == {"active": b, "previous": a} and v.read("documents").first()["n"] == 2 and v.read("documents").columns == ["main_sku", "n"]
    assert v.rollback() == a and v.read("documents").first()["n"] == 1
    v.verify()
    with v.writer(), pytest.raises(BusyError), v.writer():
        pass
    with v.writer():  # given back
        pass


def test_a_name_is_made_once(spark, tmp_path):
    store, won = Store(spark, f"file://{tmp_path}"), []
    threads = [threading.Thread(target=lambda i=i: store.publish("log/1.json", {"by": i}) and won.append(i)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.read("log/1.json") == {"by": won[0]} and store.names("log") == ["1.json"] and store.names("none") == []


def test_lease(spark, tmp_path):
    now = [100.0]
    store = Store(spark, f"file://{tmp_path}")
    a, b = (Lease(store, seconds=10, clock=lambda: now[0]) for _ in range(2))
    a.acquire()
    with pytest.raises(BusyError):
        b.acquire()
    now[0] += 9
    a.renew()
    now[0] += 9
    with pytest.raises(BusyError):
        b.acquire()
    now[0] += 2  # ran out
    b.acquire()
    for late in (a.check, a.renew):
        with pytest.raises(BusyError):
            late()
    a.release()  # takes nothing from b
    b.check()
    b.release()
    a.acquire()


def test_two_publishers(spark, v):
    """A writer whose lease ran out while it wrote cannot publish over the one that took it."""
    df = frame(spark, ("A", 1))
    v.rebuild({"s": "0"}, {"t": df})
    other = Versions(spark, v.store.root)

    def steal(tables):
        number, last = v.store.newest("lease")
        v.store.append("lease", number + 1, last | {"until": 0.0})
        other.rebuild({"s": "other"}, {"t": df.withColumn("n", F.lit(5))})
        return tables["t"].where("false")

    with pytest.raises(BusyError):
        v.rebuild({"s": "late"}, {"t": df}, {"steal": steal})
    assert v.read("t").first()["n"] == 5 and len([n for n in v.store.names("") if n.startswith("2")]) == 2


def test_pinned(spark, v):
    v.rebuild({"s": "0"}, {"t": frame(spark, ("A", 0)), "u": frame(spark, ("A", 0))})
    tries = []

    def plan(now):
        tries.append(now.version)
        return now.table("t").join(now.table("u").withColumnRenamed("n", "m"), "main_sku")

    def act(df, until):
        if len(tries) <= until:
            n = len(tries)
            v.rebuild({"s": f"{until}-{n}"}, {"t": frame(spark, ("A", n)), "u": frame(spark, ("A", n))})
        return [tuple(r) for r in df.collect()]

    assert v.pinned(plan, lambda d: act(d, 1)) == [("A", 1, 1)] and len(tries) == 2
    tries.clear()
    with pytest.raises(DataChangedError):
        v.pinned(plan, lambda d: act(d, 9))


def test_differences(spark, v):
    rows = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), F.lit(None).cast("string").alias("empty"))
    twice = rows.unionByName(rows.where("k = 8"))
    a = v.rebuild({"s": "a"}, {"t": rows, "u": rows.where("k <> 9"), "same": rows})
    b = v.rebuild({"s": "b"}, {"t": twice.where("k <> 5").withColumn("x", F.when(F.col("k") == 77, 99).otherwise(F.col("x"))), "u": rows, "same": rows.repartition(7)}, base=a)
    assert {tuple(r) for r in v.differences(a, b, "t").collect()} == {(5, "removed"), (77, "changed"), (8, "changed")}
    assert v.differing_leaves(a, b, "same") == [] and v.differences(a, b, "same").count() == 0 and 1 <= len(v.differing_leaves(a, b, "t")) <= 3 < LEAVES
    plan = v.differences(a, b, "t")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(__leaf" in plan
    assert [tuple(r) for r in v.unmatched_keys(a, "t", "u").collect()] == [("9", "t")]
    assert {tuple(r) for r in v.unmatched_keys(b, "u", "t").collect()} == {("5", "u"), ("8", "t")}
    assert v.lineage(b) == [b, a]
    v.require_base(b, a)
    with pytest.raises(LineageError):
        v.require_base(a, b)
    # another table in the place of one: the tree tells which leaves
    rows.withColumn("x", F.when(F.col("k") == 3, 0).otherwise(F.col("x"))).write.mode("overwrite").parquet(f"{v.store.root}/{a}/t")
    v._listed.clear()
    with pytest.raises(RuntimeError, match="leaves"):
        v.verify(a)


def test_purge(spark, v):
    df = frame(spark, ("A", 1))
    names = [v.rebuild({"s": str(i)}, {"t": df.withColumn("n", F.lit(i))}) for i in range(3)]
    names.append(v.rebuild({"s": "3"}, {"t": df}, base=names[1]))
    assert v.purge() == [names[0]] and v.lineage(names[3]) == [names[3], names[1]] and v.rollback() == names[2] and v.purge() == []


def test_nulls_and_empty_tables(spark, v):
    nulls = frame(spark, (None, None), ("A", None), (None, 1))
    a = v.rebuild({"s": "a"}, {"t": nulls, "none": frame(spark)})
    b = v.rebuild({"s": "b"}, {"t": nulls.where("n is null"), "none": frame(spark, ("X", 1))})
    assert [tuple(r) for r in v.differences(a, b, "t").collect()] == [(None, "changed")]
    assert [tuple(r) for r in v.differences(a, b, "none").collect()] == [("X", "added")]
    v.verify(a)
