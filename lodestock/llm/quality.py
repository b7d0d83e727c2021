"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Every document gets rule statistics of its whole text. Trees split labelled documents at random features and random
places; a document that few splits suffice to isolate has a short mean path and a high score. Every labelled document is
in at least one tree, and in as many as give a tree `tree_rows` rows on average; each tree is grown in a task of its own from the ratios dealt to it.
The threshold is the one that parts the labelled good from the labelled bad best, among those that reject at most
`most_rejected` of the labelled good ones. All labelled documents are scored and counted for it, in `cells` equal intervals of
the score; the least score of each interval is tried.

Nulls: a null text has no words and fails the base rules; rows with a null id or null label are not learnt from. Of labels that
contradict each other the smaller counts, and of several texts of one labelled id the one whose ratios come first. Without
labelled rows of both kinds the forest rejects nothing. Empty texts fail the base rules. Repeated rows get repeated
results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch, build_filter, each_text, filter_bits, in_filter, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the forest sees; none of them grows with a text's length. Shares of repeated lines and of digits isolated
#: many labelled good documents, and so are left to the base rules.
FEATURES = ("symbols_per_word", "repeat_share", "mean_word", "upper_share", "bang_per_word", "echo_share")
SYMBOLS = b"#*$%&|<>"
BASE_MIN_WORDS = 50
BASE_REPEAT_PERCENT = 50
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
KEPT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])
TREE = pa.schema([("tree", pa.int32()), ("n", pa.int64()), ("feature", pa.list_(pa.int32())), ("split", pa.list_(pa.float64())), ("length", pa.list_(pa.float64()))])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    seen: dict[tuple, int] = {}
    marks = bytearray(len(words))
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        first = seen.setdefault(w, i)
        if first != i:
            marks[first : first + 3] = marks[i : i + 3] = b"\1\1\1"
    return sum(marks)


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def without(data: bytes, these: bytes) -> int:
    return len(data) - len(data.translate(None, these))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the ratios of one whole text (UTF-8)."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    size = chars(joined)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    symbols = without(joined, SYMBOLS)
    repeat = repeated_words(words)
    upper, lower = (without(joined, x) for x in (UPPER, LOWER))
    echo = sum(map(bytes.__eq__, words, words[1:]))
    of = max(n, 1)
    ratios = [math.log1p(8 * symbols / of), repeat / of, math.log1p(size / of), upper / max(upper + lower, 1), math.log1p(8 * joined.count(b"!") / of), echo / of]
    return [n, size, symbols, dup, repeat], ratios


@dataclass(frozen=True)
class Forest:
    """Complete binary trees as arrays: at an inner node the feature and the split, at a leaf the path length (feature -1)."""

    feature: np.ndarray
    split: np.ndarray
    length: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= split[at]))
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, split and length at each node of one tree; they depend on the set of rows, not on their order."""
    nodes = 2 ** (depth + 1) - 1
    feature, split, length = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, x)]
    while todo:
        at, level, rows = todo.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(open_):
            length[at] = level + mean_path(len(rows))
            continue
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        feature[at], split[at] = f, cut
        right = rows[:, f] >= cut
        todo += [(2 * at + 1, level + 1, rows[~right]), (2 * at + 2, level + 1, rows[right])]
    return feature, split, length


def depth_of(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(rows, 2))))


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """A forest of rows in memory, each tree from a sample of them."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = depth_of(sample)
    grown = [grow_tree(x[rng.choice(len(x), sample, replace=False)], depth, rng) for _ in range(trees)]
    return Forest(*map(np.array, zip(*grown)), depth, max(mean_path(sample), 1e-9))


def _tree(depth: int, seed: int):
    def tree(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x = matrix(rows["ratios"])
        grown = grow_tree(x, depth, np.random.default_rng((seed, key[0].as_py())))
        return pa.Table.from_pylist([{"tree": key[0].as_py(), "n": len(x), **dict(zip(("feature", "split", "length"), grown))}], TREE)

    return tree


def matrix(ratios: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(ratios, pa.ChunkedArray):
        ratios = ratios.combine_chunks()
    return np.asarray(ratios.flatten(), dtype=np.float64).reshape(len(ratios), len(FEATURES))


def grown(learnt: DataFrame, rows: int, trees: int, tree_rows: int, seed: int) -> Forest:
    """A forest that all of `learnt` (doc_id, ratios; `rows` rows) go into: a row into the trees whose hashes with its id are least."""
    each = min(trees, max(1, math.ceil(trees * tree_rows / rows)))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("doc_id", t).alias("h"), t.alias("tree"))))
    dealt = learnt.select(F.explode(F.slice(order, 1, each)["tree"]).alias("tree"), "ratios")
    depth = depth_of(min(tree_rows, rows))
    kind = "tree int, n long, feature array<int>, split array<double>, length array<double>"
    found = dealt.groupBy("tree").applyInArrow(_tree(depth, seed), kind).toArrow().sort_by("tree")  # a row a tree
    feature, split, length = (np.array(found[c].to_pylist()) for c in ("feature", "split", "length"))
    return Forest(feature, split, length, depth, max(float(np.mean([mean_path(n) for n in found["n"].to_pylist()])), 1e-9))


def best_cut(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, most_rejected: float) -> float:
    """The score from which documents are rejected: one of `cuts`, ascending, with the numbers of rows from each up to the next."""
    if not good.sum() or not bad.sum():
        return math.inf
    rejected_good, rejected_bad = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (good, bad))
    gain = np.where(rejected_good <= most_rejected, rejected_bad - rejected_good, -1)
    best = int(np.argmax(gain))
    return float(cuts[best]) if gain[best] > 0 else math.inf


def calibrate(scores: np.ndarray, good: np.ndarray, most_rejected: float) -> float:
    """The score from which documents are rejected, of scores in memory."""
    cuts, at = np.unique(scores, return_inverse=True)
    return best_cut(cuts, *(np.bincount(at[x], minlength=len(cuts)) for x in (good, ~good)), most_rejected)


def _cells(forest: Forest, cells: int):
    def count(batches):
        for r in batches:
            scores, good = forest.scores(matrix(r.column(1))), r.column(0).to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array((scores * cells).astype(np.int32)), pa.array(scores), pa.array(good.astype(np.int64)), pa.array((~good).astype(np.int64))], names=["cell", "cut", "good", "bad"])

    return count


def calibrated(learnt: DataFrame, forest: Forest, cells: int, most_rejected: float) -> float:
    """The score from which documents are rejected, of all of `learnt` (quality, ratios); the driver gets the counts of at most `cells` intervals."""
    counts = learnt.select("quality", "ratios").mapInArrow(_cells(forest, cells), "cell int, cut double, good long, bad long")
    found = counts.groupBy("cell").agg(F.min("cut").alias("cut"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow().sort_by("cell")
    return best_cut(*(found[c].to_numpy() for c in ("cut", "good", "bad")), most_rejected)


def _ratios(words: np.ndarray):
    def ratios(batches):
        for r in each_text(batches):
            r = r.filter(pa.array(in_filter(words, r.column(2).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([statistics(t)[1] for t in as_bytes(r.column(1))], pa.list_(pa.float64()))], names=["doc_id", "ratios"])

    return ratios


def labelled_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, ratios) of all labelled documents; one row an id, whatever repeats it. Only ids and ratios are shuffled, and a filter of ids leaves out most of the texts without a label."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    words = build_filter(known, F.xxhash64("doc_id"), filter_bits(known.count()))
    found = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_ratios(words), "doc_id long, ratios array<double>")
    return found.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("ratios").alias("ratios"))


def _judge(forest: Forest | None, threshold: float):
    def judge(batches):
        for r in each_text(batches):
            found = [statistics(t) for t in as_bytes(r.column(1))]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(len(found), len(COUNTS))
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < BASE_MIN_WORDS) | (100 * repeat > BASE_REPEAT_PERCENT * n)
            scores = forest.scores(np.array([x for _, x in found])) if forest and found else np.zeros(len(found))
            yield batch(KEPT, {"doc_id": r.column(0), **{c: counts[:, i] for i, c in enumerate(COUNTS)}, "base_failed": failed, "kept": ~failed & (scores < threshold), "score": scores})

    return judge


def fitted(docs: DataFrame, labels: DataFrame, trees: int, tree_rows: int, cells: int, most_rejected: float, seed: int) -> tuple[Forest | None, float]:
    """The forest and the score from which documents are rejected. docs: (doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        learnt = scratch.written(labelled_ratios(docs, labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "labelled")
        rows = learnt.count()
        if rows < 2:
            return None, math.inf
        forest = grown(learnt, rows, trees, tree_rows, seed)
        return forest, calibrated(learnt, forest, cells, most_rejected)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = 100, tree_rows: int = 256, cells: int = 4096, most_rejected: float = 0.01, seed: int = 7
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score), one row for each row of `docs`.

    `labels` has (doc_id, quality 0 or 1); all of its rows that a document has are learnt from. The driver gets the trees and the counts of `cells` intervals.
    """
    source = _plain(docs, id_col, text_col)
    forest, threshold = fitted(source, labels, trees, tree_rows, cells, most_rejected, seed)
    kind = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS))
    return source.mapInArrow(_judge(forest, threshold), f"{kind}, base_failed boolean, kept boolean, score double")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trees: int = 100, tree_rows: int = 256, cells: int = 4096, most_rejected: float = 0.01, seed: int = 7
) -> DataFrame:
    """The rows of `docs` that quality_rules keeps, with all their columns, in one pass and without a join."""
    forest, threshold = fitted(_plain(docs, id_col, text_col), labels, trees, tree_rows, cells, most_rejected, seed)
    judge = _judge(forest, threshold)
    text_at = docs.columns.index(text_col)

    def keep(batches):
        for r in each_text(batches):
            pair = pa.RecordBatch.from_arrays([pa.nulls(r.num_rows, pa.int64()), r.column(text_at)], names=["doc_id", "text"])
            yield r.filter(next(judge([pair])).column("kept")) if r.num_rows else r

    return docs.mapInArrow(keep, docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
