"""Exact duplicates by a log-structured merge index of digests.

One pass over the texts fills a memtable in each task; a full memtable is flushed as a run sorted by digest, in which
the best row of each digest is marked and carries the run's count, so that compaction shuffles one entry per digest
and run, never one per copy. Compaction keeps, per digest, the entry with the most code points, then the smallest
identifier. A bounded bit filter over the digests that compaction found more than once picks the texts that a second
pass brings to byte verification. A task compares its own hits of a digest byte for byte and hands on one body of each that differs, so
that a large group of copies is a body a task; digests with two bodies (the digest clashes) are grouped anew by their bytes.

Nulls: a null text counts as empty; a null id sorts after all others. Empty texts form one group. Repeated rows: one of
them stays, the first in the order of the input files. An empty table gives an empty result. Other columns of the input
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch, build_filter, each_text, filter_bits, hashed, in_filter, written

#: The characters that do not count: space and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"
RUN = pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("row", pa.int64()), ("run_best", pa.bool_()), ("run_count", pa.int64())])
BODY = pa.schema([("digest", pa.string()), ("body", pa.binary())])
#: Bytes of bodies that a task holds.
HELD = 16_000_000
HIT = pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("row", pa.int64()), ("body", pa.binary())])


def sha256(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _rows(batches, digest: Callable[[bytes], str]):
    """(digest, id, code points, row key, normalised bytes) in input order; row keys tell repeated rows of one pass apart."""
    row = TaskContext.get().partitionId() << 40
    for r in each_text(batches):
        lengths = [n or 0 for n in pc.utf8_length(r.column(1)).to_pylist()]
        for doc_id, text, chars in zip(r.column(0).to_pylist(), as_bytes(r.column(1)), lengths):
            body = text.translate(None, BLANKS)
            yield digest(body), doc_id, chars, row, body
            row += 1


def _better(x: tuple, y: tuple) -> bool:
    """Entries are (digest, doc_id, chars, row)."""
    return (-x[2], x[1] is None, x[1] or 0, x[3]) < (-y[2], y[1] is None, y[1] or 0, y[3])


def _runs(memtable_rows: int, digest):
    def flush(memtable: list[tuple], best: dict[str, tuple], counts: dict[str, int]) -> pa.RecordBatch:
        memtable.sort(key=lambda x: (x[0], x[3]))
        marks = [best[x[0]] is x for x in memtable]
        return batch(RUN, dict(zip(RUN.names, [*([x[i] for x in memtable] for i in range(4)), marks, [counts[x[0]] for x in memtable]])))

    def run(batches):
        memtable, best, counts = [], {}, {}
        for key, doc_id, chars, row, _ in _rows(batches, digest):
            entry = (key, doc_id, chars, row)
            memtable.append(entry)
            if key not in best or _better(entry, best[key]):
                best[key] = entry
            counts[key] = counts.get(key, 0) + 1
            if len(memtable) >= memtable_rows:
                yield flush(memtable, best, counts)
                memtable, best, counts = [], {}, {}
        if memtable:
            yield flush(memtable, best, counts)

    return run


def _bodies(words: np.ndarray, digest):
    """The different bodies of each digest that the filter lets pass, once for about HELD bytes of them."""

    def bodies(batches):
        held: dict[tuple[str, bytes], None] = {}
        size = 0
        for key, _, _, _, body in _rows(batches, digest):
            if (key, body) not in held and in_filter(words, np.array([hashed(key.encode())], dtype=np.uint64))[0]:
                held[key, body] = None
                size += len(body)
            if size > HELD:
                yield batch(BODY, dict(zip(BODY.names, zip(*held))))
                held, size = {}, 0
        if held:
            yield batch(BODY, dict(zip(BODY.names, zip(*held))))

    return bodies


def _hits(words: np.ndarray, digest):
    def hits(batches):
        out: list[tuple] = []
        size = 0
        for entry in _rows(batches, digest):
            if in_filter(words, np.array([hashed(entry[0].encode())], dtype=np.uint64))[0]:
                out.append(entry)
                size += len(entry[4])
            if size > 8_000_000:
                yield batch(HIT, dict(zip(HIT.names, zip(*out))))
                out, size = [], 0
        if out:
            yield batch(HIT, dict(zip(HIT.names, zip(*out))))

    return hits


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 100_000, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), one row for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = written(source.mapInArrow(_runs(memtable_rows, digest), "digest string, doc_id long, chars long, row long, run_best boolean, run_count long"), "runs")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    compacted = runs.where("run_best").groupBy("digest").agg(F.min(order).alias("best"), F.sum("run_count").alias("n")).where("n > 1")
    index = written(compacted.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), "index")
    found = runs.join(index, "digest", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"), "digest",
    )
    again = _verified(source, index, digest)
    if again is not None:
        found = found.join(again.select("digest").distinct(), "digest", "left_anti").select(*again.columns).unionByName(again)
    return found.select("doc_id", "keep_id", "group_size", "kept", "digest")


def _verified(source: DataFrame, index: DataFrame, digest) -> DataFrame | None:
    """Compares the bytes of all hits of each digest. None if all agree; else the groups of the digests that don't, by bytes."""
    repeated = index.count()
    if not repeated:
        return None
    with Scratch(source.sparkSession) as scratch:
        words = build_filter(index, F.xxhash64("digest"), filter_bits(repeated))
        bodies = source.mapInArrow(_bodies(words, digest), "digest string, body binary")
        clashes = written(bodies.groupBy("digest").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("digest"), "clashes")
        clashing = clashes.count()
        if not clashing:
            return None
        words = build_filter(clashes, F.xxhash64("digest"), filter_bits(clashing))
        hits = source.mapInArrow(_hits(words, digest), "digest string, doc_id long, chars long, row long, body binary")
        rows = scratch.written(hits.join(clashes, "digest", "left_semi"), "hits")
        order = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
        groups = rows.groupBy("digest", "body").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        grouped = rows.join(groups, ["digest", "body"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("row")).alias("kept"), "digest")
        return written(grouped, "regrouped")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


SQL = """
with d as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, cast(count(*) over (partition by text_sha256) as bigint) as group_size, doc_id = first_value(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256 order by chars desc, doc_id)
"""
