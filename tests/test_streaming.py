"""Keyed state: only touched folders are rewritten, batches are merged once, late and reparented rows go aside."""

from pyspark.sql import functions as F

from lodestock.streaming.upsert import KeyedState, stream_into


def rows(spark, *r):
    return spark.createDataFrame(list(r), "sku string, main string, at int")


def of(df):
    return {r["sku"]: (r["main"], r["at"]) for r in df.collect()}


def test_keyed_state(spark, tmp_path):
    s = KeyedState(spark, f"file://{tmp_path}", rows(spark).schema, key="sku", order="at", parent="main", buckets=4)
    assert s.state().count() == 0 and s.rejected().count() == 0
    s.merge(rows(spark, ("a", "A", 1), ("a", "A", 3), ("a", "X", 4), ("b", "B", 1), (None, "N", 1)), 0)
    assert of(s.state()) == {"a": ("A", 3), "b": ("B", 1), None: ("N", 1)}
    before = s.store.newest("log")[1]["buckets"]
    s.merge(rows(spark, ("a", "A", 2), ("a", "B", 9), ("a", "A", 5)), 1)
    after = s.store.newest("log")[1]["buckets"]
    assert sum(before.get(b) != f for b, f in after.items()) == 1  # the folder of `a` alone
    s.merge(rows(spark, ("b", "B", 7)), 1)  # a batch that was merged already
    assert of(s.state()) == {"a": ("A", 5), "b": ("B", 1), None: ("N", 1)}
    assert sorted((r["sku"], r["main"], r["at"], r["reason"], r["batch"]) for r in s.rejected().collect()) == [("a", "A", 2, "late", 1), ("a", "B", 9, "reparented", 1), ("a", "X", 4, "reparented", 0)]
    for n in range(2, 7):
        s.merge(rows(spark, ("a", "A", 10 + n), ("c", "C", n)), n)
    assert of(s.state())["a"] == ("A", 16) and len([f for f in s.store.names("state")]) <= 4  # of five older batches, what is still in force
    s.merge(rows(spark), 7)
    assert of(s.state())["c"] == ("C", 6)


def test_restart(spark, tmp_path):
    """A stream that starts again goes on with the files it has not seen."""
    get = lambda: KeyedState(spark, f"file://{tmp_path}/s", rows(spark).schema, key="sku", order="at")
    rows(spark, ("a", "A", 1), ("b", "B", 1)).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    assert of(stream_into(spark, f"file://{tmp_path}/in/", get()).state()) == {"a": ("A", 1), "b": ("B", 1)}
    rows(spark, ("a", "Z", 2)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    s = stream_into(spark, f"file://{tmp_path}/in/", get())
    assert of(s.state()) == {"a": ("Z", 2), "b": ("B", 1)} and s.store.newest("log")[0] == 2


def test_hot_key(spark, tmp_path):
    s = KeyedState(spark, f"file://{tmp_path}", rows(spark).schema, key="sku", order="at")
    s.merge(spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sku"), F.lit("M").alias("main"), F.col("id").cast("int").alias("at")), 0)
    assert s.state().where("sku = 'hot'").first()["at"] == 49_998 and s.state().count() == 33_334
