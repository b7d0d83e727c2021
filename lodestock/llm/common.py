"""What the corpus operators share: the shared work folder, written tables, bounded filters, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions that one key sets in a filter, and the bits of the key between them.
FILTER_HASHES, FILTER_SHIFT = 3, 19
_local_dir: str | None = None
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def work_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: `spark.checkpoint.dir`; a temporary one only for a local master without it."""
    global _local_dir
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lodestock-")
    return f"file://{_local_dir}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/lodestock/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more, which it else does when a driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables of one call, in a folder of their own within the shared one. The folder goes when the call has written its result.

    What is left by a driver that died stays under `spark.checkpoint.dir`/lodestock/scratch-*.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{work_dir(spark)}/lodestock/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self._delete(self.folder)
        swept(self.spark)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Like `written`, until the call ends."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            self._delete(path)


def free_name(taken: Iterable[str], base: str) -> str:
    """`base`, with underscores as far as a column has that name (in any case) already."""
    names = {t.lower() for t in taken}
    while base.lower() in names:
        base += "_"
    return base


def filter_bits(rows: int, least: int = 1 << 16, most: int = 1 << 26) -> int:
    """A power of two of at least sixteen bits a row; 2^26 bits (8 MB) at most, beyond which a filter lets more rows pass."""
    return min(max(1 << (16 * rows - 1).bit_length() if rows else 0, least), most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def build_filter(keys: DataFrame, key: Column, bits: int = 1 << 23, hashes: int = FILTER_HASHES) -> np.ndarray:
    """Bit filter over a column of hashed 64-bit keys, OR-ed on the executors; at most bits / 64 words reach the driver whatever the input.

    A filter too small for its keys lets more rows pass; it never loses one. `bits`: a power of two, at most 2^26.
    """
    at = F.explode(F.array(*[F.shiftrightunsigned(key, FILTER_SHIFT * i).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]))
    words = (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, keys: np.ndarray, hashes: int = FILTER_HASHES) -> np.ndarray:
    """Whether each of the hashed keys (uint64) may be in the filter."""
    out = np.ones(len(keys), dtype=bool)
    for i in range(hashes):
        at = (keys >> np.uint64(FILTER_SHIFT * i)) & np.uint64(len(words) * 64 - 1)
        out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def hashed(value: bytes | int) -> int:
    """What Spark's xxhash64 gives for a string or a long, as an unsigned number."""
    return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else (value & (1 << 64) - 1).to_bytes(8, "little"), 42)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex in `edges` (a, b: long): alternating large-star and small-star rounds.

    Each round is a min aggregate, combined before the shuffle, and a join back; a hub is a skewed join that the
    adaptive planner splits. Rounds are written to the shared folder, so a lost executor repeats one round only.
    Returns (v, root) for vertices that have a link, as a written table.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = None
        for _ in range(most_rounds):
            near = both(now)
            least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            small = small.unionByName(low.select("a", F.col("m").alias("b")))
            small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            before, now = now, scratch.written(small, "edges")
            scratch.dropped(before)
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(seen) == mark:
                break
            mark = tuple(seen)
        else:
            raise RuntimeError("components did not settle")
        stars = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        return written(stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct()), "components")


def batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def release() -> None:
    """Gives what a task has freed back to the system: workers live on, and an executor's memory counts them all."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def each_text(rows: Iterable[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` rows, so that Python holds few whole texts at once."""
    for r in rows:
        for at in range(0, r.num_rows, most):
            yield r.slice(at, most)
    release()
