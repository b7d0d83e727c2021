"""Streams of partial files: state by key that a batch rewrites only where it touches it, rejected rows aside, and stock snapshots that replace what was there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.store import Store

#: Folders that a state's keys are dealt over.
BUCKETS = 16


class KeyedState:
    """The last row of each key, in folders by a hash of the key, and the rows that were rejected.

    A batch reads and rewrites the folders of its keys alone; entry b + 1 of the log says which batch's folder of each bucket is in force after
    batch b. A batch that the log has is not merged again. Folders that neither the last entry nor the one before it names are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, *, key: str, order: str, parent: str | None = None, buckets: int = BUCKETS):
        self.spark, self.store, self.schema = spark, Store(spark, root), schema
        self.key, self.order, self.parent, self.buckets = key, order, parent, buckets

    def _held(self, entry: dict | None, buckets: list[int] | None = None) -> DataFrame:
        held = {int(b): n for b, n in (entry or {}).get("buckets", {}).items()}
        paths = [f"{self.store.root}/state/{n}/bucket={b}" for b, n in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        return self._held(self.store.newest("log")[1])

    def rejected(self) -> DataFrame:
        """All rejected rows, with batch and reason: reparented (its key has another parent) or late (its key has a later row)."""
        schema = StructType([*self.schema.fields]).add("reason", "string").add("batch", "integer")
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/rejected") if self.store.exists("rejected") else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """A batch's rows by key: of the accepted ones the last wins, what is in force stays otherwise.

        A key keeps the parent of its first row (the first of the batch that brings it); rows of another are rejected, as are rows of a key whose row in force is not older.
        """
        number, entry = self.store.newest("log")
        if number > batch_id:
            return
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most as many as there are buckets
            held = self._held(entry, touched)
            was = held.select(F.col(self.key).alias("__k"), F.col(self.order).alias("__at"), *([F.col(self.parent).alias("__of")] if self.parent else []))
            judged = batch.join(was, batch[self.key].eqNullSafe(was["__k"]), "left")
            moved = F.lit(False)
            if self.parent:
                first = batch.groupBy(F.col(self.key).alias("__f")).agg(F.min_by(self.parent, self.order).alias("__first"))
                judged = judged.join(first, judged[self.key].eqNullSafe(first["__f"]))
                own = F.when(F.col("__at").isNotNull(), F.col("__of")).otherwise(F.col("__first"))
                moved = ~F.col(self.parent).eqNullSafe(own)
            late = F.col("__at").isNotNull() & (F.col(self.order) <= F.col("__at"))
            judged = judged.withColumn("reason", F.when(moved, "reparented").when(late, "late")).select(*self.schema.names, "bucket", "reason")
            bad = judged.where("reason is not null").drop("bucket")
            bad.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.store.root}/rejected")
            new = judged.where("reason is null").groupBy("bucket", self.key).agg(F.max_by(F.struct(*self.schema.names), self.order).alias("r")).select("bucket", "r.*")
            kept = held.join(new.select(F.col(self.key).alias("__n")), F.col(self.key).eqNullSafe(F.col("__n")), "left_anti").withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            folder = f"{batch_id}-{uuid.uuid4().hex[:8]}"  # a try that failed leaves its own folder only
            new.select(*self.schema.names, "bucket").unionByName(kept.select(*self.schema.names, "bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.store.root}/state/{folder}")
        finally:
            batch.unpersist()
        written = {n.removeprefix("bucket="): folder for n in self.store.names(f"state/{folder}") if n.startswith("bucket=")}
        now = (entry or {}).get("buckets", {}) | written
        if not self.store.append("log", batch_id + 1, {"batch": batch_id, "buckets": now}):
            return  # another run of the same batch was first
        in_use = {(f, b) for e in (now, (entry or {}).get("buckets", {})) for b, f in e.items()}
        for f in self.store.names("state"):
            mine = [b for b in self.store.names(f"state/{f}") if b.startswith("bucket=")]
            gone = [b for b in mine if (f, b.removeprefix("bucket=")) not in in_use]
            for name in [f"state/{f}"] if len(gone) == len(mine) else [f"state/{f}/{b}" for b in gone]:
                self.store.delete(name)


def stream_into(spark: SparkSession, source: str, state: KeyedState, *, files_per_batch: int = 1) -> KeyedState:
    """All files at `source`, batch by batch in the order of their time, merged into `state`; a restart goes on where the last run ended."""
    stream = spark.readStream.schema(state.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source if source.endswith("/") else glob_of(source))
    q = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{state.store.root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return state


def stream_upsert(spark: SparkSession, source: str, work: str, *, key: str, order: str, files_per_batch: int = 1) -> DataFrame:
    """All files at `source`, batch by batch, merged by key; returns the state after the last."""
    state = KeyedState(spark, f"{work}/stream-{uuid.uuid4().hex}", spark.read.parquet(source).schema, key=key, order=order)
    return stream_into(spark, source, state, files_per_batch=files_per_batch).state()


def glob_of(source: str) -> str:
    """A stream reads folders: a single file is given as a glob that matches it alone."""
    head, _, name = source.rpartition("/")
    return f"{head}/{name[:-1]}[{name[-1]}]"


def replace_snapshot(spark: SparkSession, source: str, work: str, schema, by: str = "country") -> list[int]:
    """Each file is a whole snapshot: the table is overwritten, the one before kept beside it."""
    done: list[int] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{work}/snapshot-{batch_id % 2}")
        done.append(batch_id)

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/snapshot-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return done
