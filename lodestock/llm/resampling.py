"""Target-distribution importance resampling over hashed n-grams, read by a vectorised byte automaton.

The Arrow buffer of a column's UTF-8 bytes is classified by one lookup table (0 for a byte of no word, else the lower-cased byte);
words are where the class turns from 0 and back, found by differences; the table-driven CRC-32 of all words advances one byte a
step for all of them at once, longest words first, so that a step touches only words that go on. What is beyond STEPS bytes of a word
goes on from its state in zlib. The CRC of several words joined by a space goes on from that of the words before.

A feature's bucket is its CRC-32 modulo `buckets`. Counts by bucket over all documents and over all target texts are summed by Spark
(at most `buckets` rows reach the driver, whatever the input) and give each bucket's gain; a document's weight is the floored mean
of its features' gains. Gumbel noise from a hash of seed and id turns the draw without replacement into taking the highest scores. They
are ranked by a distributed sort of those at or above the cut, which is read off the counts of each score: a score is a whole number
within +-120,000 at any size of the input.

Nulls: a null text has no features and weight 0; a null id draws like the empty id and comes after the others of its score. Rows that
share an id share its noise. Ties are settled by the smaller id, then by place. An empty table gives an empty result, without target
texts every gain is that of T = 0. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, each_text, table, written

#: Bytes dealt with at a time, and bytes of a word that all words are advanced by together.
PIECE, STEPS = 1 << 20, 64
COUNT = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class Plan:
    """Features of 1 to `grams` words; of the documents with `least_words` words, `percent` are drawn."""

    grams: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    letter = (out >= 65) & (out <= 90)
    out[letter] += 32
    out[~(((out >= 48) & (out <= 57)) | ((out >= 97) & (out <= 122)) | (out >= 128))] = 0
    return out


def _crcs() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CLASS, CRC = _classes(), _crcs()


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC registers `state` (before the final inversion) after the bytes from each start to each end."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, STEPS), kind="stable")
    state, at, left = state[order], starts[order], np.minimum(size, STEPS)[order]
    going = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")  # words of more than i bytes come first
    for i, n in enumerate(going.tolist()):
        now = state[:n]
        state[:n] = CRC[(now ^ data[at[:n] + i]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    for w in np.flatnonzero(size > STEPS):
        out[w] = ~np.uint32(zlib.crc32(data[starts[w] + STEPS : ends[w]].tobytes(), int(~out[w])))
    return out


def _pieces(offsets: np.ndarray, data: np.ndarray, whole: bool) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte): rows of about PIECE bytes together; a longer text in parts, cut where no word is, unless `whole`."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[last])
        while not whole and b - a > PIECE:
            cut = a + PIECE
            while cut < b and (gap := np.flatnonzero(CLASS[data[cut : cut + PIECE]] == 0)).size == 0:
                cut += PIECE
            cut = min(cut + int(gap[0]), b) if cut < b else b
            yield row, last, a, cut
            a = cut
        yield row, last, a, b
        row = last


def features(column: pa.Array, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket) of every feature of a string column, piece by piece, and how many of them, the first, are single words."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    space = CRC[np.arange(256) ^ 32]  # what a space makes of a register's low byte
    for first, last, a, b in _pieces(offsets, data, plan.grams > 1):
        kind = CLASS[data[a:b]]
        word = np.concatenate([[False], kind > 0, [False]])
        turn = word[1:] != word[:-1]
        # texts lie side by side: a word at the end of one is no part of the next one's first word
        edge = offsets[first + 1 : last] - a
        edge = edge[(edge > 0) & (edge < b - a)]
        split = edge[word[edge] & word[edge + 1]]
        starts, ends = np.flatnonzero(turn & word[1:]), np.flatnonzero(turn & word[:-1])
        if len(split):
            split = np.unique(split)
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
        row = first + np.searchsorted(offsets[first + 1 : last], starts + a, "right")
        state = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), kind, starts, ends)
        rows, states = [row], [state]
        for g in range(1, min(plan.grams, max(len(starts), 1))):
            more = row[g:] == row[:-g]  # the g words before are of the same text
            at = np.flatnonzero(more)
            state = state[: len(starts) - g][at] if g == 1 else state[np.searchsorted(before, at)]
            state = space[state & np.uint32(255)] ^ (state >> np.uint32(8))
            state = advance(state, kind, starts[at + g], ends[at + g])
            before = at
            rows.append(row[at])
            states.append(state)
        yield np.concatenate(rows), (~np.concatenate(states) % np.uint32(plan.buckets)).astype(np.int64), len(starts)


def _count(plan: Plan):
    def count(rows):
        total = np.zeros(plan.buckets, np.int64)
        for r in each_text(rows):
            for _, bucket, _ in features(r.column(0), plan):
                total += np.bincount(bucket, minlength=plan.buckets)
        some = np.flatnonzero(total)
        yield batch(COUNT, {"bucket": some, "n": total[some]})

    return count


def bucket_counts(texts: DataFrame, plan: Plan) -> np.ndarray:
    """Features in each bucket over all of `texts` (one column)."""
    counted = texts.mapInArrow(_count(plan), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(plan.buckets, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, floored; one is added to every count."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a standard Gumbel draw, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(plan: Plan, gain: np.ndarray):
    def score(rows):
        for r in each_text(rows):
            n, words, total = (np.zeros(r.num_rows, np.int64) for _ in range(3))
            for row, bucket, single in features(r.column(1), plan):
                n += np.bincount(row, minlength=r.num_rows)
                words += np.bincount(row[:single], minlength=r.num_rows)
                total += np.bincount(row, gain[bucket], minlength=r.num_rows).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield batch(SCORED, {"doc_id": r.column(0), "n_words": words, "n_features": n, "weight": weight, "score": weight + np.array([noise(i, plan.seed) for i in r.column(0).to_pylist()], dtype=np.int64)})

    return score


def ranked(scored: DataFrame, draw: int, scratch: Scratch) -> DataFrame:
    """`scored` (doc_id, score, eligible, place, ...) plus rank, 1 to `draw` by score, id and place; place: unique."""
    spark = scored.sparkSession
    cut, above = None, 0
    for s, n in scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).toLocalIterator():
        if above < draw:
            cut, above = s, above + n
    may = F.col("eligible") & (F.col("score") >= cut) if cut is not None else F.lit(False)
    # the sorted rows' numbers hold task and place in it; the rows of earlier tasks make them ranks
    number = F.monotonically_increasing_id()
    best = scratch.written(scored.where(may).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "place").withColumn("number", number), "best")
    task = F.shiftrightunsigned("number", 33)
    before, done = [], 0
    for t, n in sorted(best.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()):  # a row a task of the sort
        before.append((t, done))
        done += n
    offsets = spark.createDataFrame(before, "task long, before long")
    rank = F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    best = best.withColumn("task", task).join(F.broadcast(offsets), "task").withColumn("rank", F.when(rank <= draw, rank)).drop("task", "before", "number")
    return best.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of `docs`; rank is null for a document that is not drawn."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(source.select("text"), plan), bucket_counts(target.select(F.col(target_col).cast("string").alias("text")), plan))
    with Scratch(docs.sparkSession) as scratch:
        scored = source.mapInArrow(_score(plan, gain), "doc_id long, n_words long, n_features long, weight long, score long")
        scored = scratch.written(scored.withColumn("eligible", F.col("n_words") >= plan.least_words).withColumn("place", F.monotonically_increasing_id()), "scored")
        draw = plan.percent * scored.where("eligible").count() // 100
        return written(ranked(scored, draw, scratch).select("doc_id", "n_features", "weight", "score", "rank"), "resampled")


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
with table_of as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crcs),
doc_words as (select doc_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as w from documents),
target_words as (select unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as w from benchmark),
counts as (select doc_id, w, count(*) as n from doc_words group by all),
words as (select w, hex(encode(w)) as x from (select w from counts union select w from target_words)),
buckets as (select w, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, cast(length(x) // 2 as bigint)), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint)), lambda c, b: xor(c // 256, crcs[1 + xor(c % 256, b)]))) % 10000 as bucket from words, table_of),
raw as (select bucket, sum(n) as s from counts join buckets using (w) group by bucket),
target as (select bucket, count(*) as t from target_words join buckets using (w) group by bucket),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (coalesce((select sum(s) from raw), 0) + 10000)::double / ((s + 1)::double * (coalesce((select sum(t) from target), 0) + 10000)::double))) as g from raw left join target using (bucket)),
weights as (select doc_id, sum(n) as n_features, cast(floor(sum(n * g) / sum(n)) as bigint) as weight from counts join buckets using (w) join gain using (bucket) group by doc_id),
scored as (select d.doc_id, cast(coalesce(n_features, 0) as bigint) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double))) as bigint) as score from documents d left join weights using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, 10 * count(*) over () // 100 as draw from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= draw then place end as rank from scored left join placed using (doc_id)
"""
