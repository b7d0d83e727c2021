"""N-gram Jaccard join: an exact metric-space join over word shingles.

Jaccard distance is a metric. Equal shingle sets are one point. Two points within the radius share a shingle among the first
of each in one global order (frequent ones last), so every such shingle opens a region round one pivot, the smallest id that has
it, and each point lies in the regions of its first shingles' pivots: no pair within the radius is outside every region. In a
region the distances to the pivot are computed exactly. Points within the radius are linked to the pivot, hence connected with
each other. A pair still open has a point beyond the radius; by the triangle inequality its partner is beyond it too or
within a window of it, so only those points (the region's outside and its boundary) go on. Small remainders are joined
exactly in one task with further pivots. A large remainder is parted by several pivots at once: every point's home is the cell of
its nearest pivot (a Voronoi cell by exact distances), and it is replicated to each cell whose pivot is at most two radii
farther, where by the triangle inequality it may have a partner at home. Cells are joined like regions, and large ones
are parted again. Where cells do not halve the pairs to look at (points all equally far from each other, which no pivot tells
apart), the remainder is dealt out as pairs of blocks instead, each screened by outlines in a task of its own. The number of rounds
grows with the logarithm of the largest remainder.

What the order of shingles is affects only how many points share a region, never the result: shingles that a count over all
documents finds frequent come last, longer ones (which are rarer) before shorter ones.

Result: connected components; a component's id is its smallest document id.

Nulls: a null or blank text has no shingles and is linked with nothing; a row with a null id is linked with nothing and gets a
null component. Rows that share an id are one point set under that id. Repeated rows give repeated results, an empty table an
empty one; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch, build_filter, connected, each_text, filter_bits, hashed, in_filter, table, written
from .words import Words, grouped, mixed

#: Shingles counted at a time.
COUNTED_AT_ONCE = 2_000_000
#: Least cells of a point's outline; a larger set has the next power of two from its size on.
CELLS = 1024
#: A remainder of at most so many points is screened in one task; what is left of it is joined there up to so many points and shingles.
SCREENED_POINTS, REGION_POINTS, REGION_SHINGLES = 4096, 1024, 3_000_000
#: Pivots that part one large remainder in a round.
CELL_PIVOTS = 8
#: How a point takes part in a cell or block: only with points of other kinds, or (HOME) with all.
AWAY, OTHER, HOME = 0, 1, 2
SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("prefix", pa.binary()), ("outline", pa.binary())])
ENTRY = pa.schema([("h", pa.int64()), ("v", pa.int64())])
SET = pa.schema([("v", pa.int64()), ("set", pa.binary())])
COUNT = pa.schema([("h", pa.int64()), ("n", pa.int64())])
BOUND = pa.schema([("p", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("d", pa.float64()), ("near", pa.bool_())])
DISTANCE = pa.schema([("p", pa.int64()), ("v", pa.int64()), ("shared", pa.int64()), ("all", pa.int64())])
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MEMBER = pa.schema([("p", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("out", pa.bool_()), ("side", pa.int32())])
MEMBER_TYPE = "p long, v long, n long, out boolean, side int"


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked when percent * union <= 100 * intersection."""

    words: int = 5
    percent: int = 80

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    def linked(self, shared, union):
        return 100 * shared >= self.percent * union

    def first(self, n: int) -> int:
        """How many of a set's n shingles a linked set must share one of."""
        return n - -(-n * self.percent // 100) + 1


class Shingler:
    """Hashed shingles of whole texts: A-Z lower-cased, words parted by space and U+0009 to U+000D."""

    def __init__(self, words: int):
        self.k, self.words = words, Words()
        self.factors = np.random.default_rng(17).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _of(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(h)
        k = min(self.k, n)
        out, long = np.zeros(max(n - k + 1, 0) if n else 0, np.uint64), np.zeros(n - k + 1 if n else 0, np.int64)
        for i in range(k):
            out += h[i : n - k + 1 + i] * self.factors[i]
            long += size[i : n - k + 1 + i]
        return mixed(out + np.uint64(k)), long

    def raw(self, texts: list[bytes]):
        """For each text, in order, the hashes of all its shingles and their lengths in bytes; fewer words than a shingle make one."""
        for a, b in grouped(texts):
            h, starts, ends = self.words.split(b"\n".join(texts[a:b]).lower())
            at = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
            cut = np.searchsorted(starts, at)
            for i in range(b - a):
                some = slice(cut[i], cut[i + 1])
                yield self._of(h[some], ends[some] - starts[some])

    def sets(self, texts: list[bytes]):
        return (np.unique(h) for h, _ in self.raw(texts))


def outline(h: np.ndarray) -> np.ndarray:
    """Parity of a set's elements in each cell, as packed bits: two sets differ in at least as many elements as their outlines do in bits."""
    cells = max(CELLS, 1 << (len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The same set's outline (or a matrix of them) in fewer cells."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differ(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def apart(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least Jaccard distance of sets of n elements together whose outlines differ in so many bits."""
    return 2 * bits / np.maximum(n + bits, 1)


def _count(rule: Rule):
    def flush(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        return batch(COUNT, {"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    def count(batches):
        shingler, sets, size = Shingler(rule.words), [], 0
        for r in each_text(batches):
            for found in shingler.sets(as_bytes(r.column(0))):
                sets.append(found)
                size += len(found)
            if size >= COUNTED_AT_ONCE:
                yield flush(sets)
                sets, size = [], 0
        if sets:
            yield flush(sets)

    return count


def _signatures(rule: Rule, frequent: np.ndarray):
    def sign(batches):
        shingler, seen = Shingler(rule.words), set()
        for r in each_text(batches):
            columns: dict[str, list] = {c: [] for c in SIGNATURE.names[1:]}
            for raw, long in shingler.raw(as_bytes(r.column(1))):
                h, at = np.unique(raw, return_index=True)
                digest = xxhash.xxh3_128_hexdigest(h.tobytes())
                columns["n"].append(len(h))
                columns["digest"].append(digest)
                if not len(h) or digest in seen:  # one copy in a task stands for all
                    columns["prefix"].append(None)
                    columns["outline"].append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(digest)
                where = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
                often = frequent[where] == h if len(frequent) else np.zeros(len(h), bool)
                order = np.lexsort((h, -long[at], often))[: rule.first(len(h))]
                columns["prefix"].append(h[order].tobytes())
                columns["outline"].append(outline(h).tobytes())
            yield batch(SIGNATURE, {"doc_id": r.column(0), **columns})

    return sign


def _entries(words: np.ndarray | None):
    """(shingle, point) of every prefix; with a filter, only the shingles that it lets pass."""

    def entries(batches):
        for r in each_text(batches, 256):
            points, prefixes = r.column(0).to_numpy(), [np.frombuffer(b, np.uint64) for b in r.column(1).to_pylist()]
            h = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            v = np.repeat(points, [len(p) for p in prefixes])
            if words is not None:
                some = in_filter(words, h, 1)
                h, v = h[some], v[some]
            yield batch(ENTRY, {"h": h.view(np.int64), "v": v})

    return entries


def _sets(rule: Rule, words: np.ndarray):
    def sets(batches):
        shingler = Shingler(rule.words)
        for r in each_text(batches):
            ids = r.column(0).to_pylist()
            some = in_filter(words, np.array([hashed(i) for i in ids], dtype=np.uint64))
            texts = [t for t, ok in zip(as_bytes(r.column(1)), some) if ok]
            if texts:
                yield batch(SET, {"v": [i for i, ok in zip(ids, some) if ok], "set": [s.tobytes() for s in shingler.sets(texts)]})

    return sets


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _outlines(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _bounds(rule: Rule):
    """Least distance of each pair by its outlines, and whether it may be within the radius."""

    def bounds(batches):
        for r in each_text(batches, 2048):
            bits = np.array([differ(a, b) for a, b in zip(_outlines(r.column("xo")), _outlines(r.column("po")))], dtype=np.int64)
            n, m = r.column("n").to_numpy(), r.column("pn").to_numpy()
            near = ((100 + rule.percent) * bits <= (100 - rule.percent) * (n + m)) & rule.linked(np.minimum(n, m), np.maximum(n, m))
            least = np.maximum(apart(bits, n + m), 1 - np.minimum(n, m) / np.maximum(n, m))
            yield batch(BOUND, {"p": r.column("p"), "v": r.column("v"), "n": n, "d": least, "near": near})

    return bounds


def _distances(batches):
    for r in each_text(batches, 256):
        x, y = ([np.frombuffer(b, np.uint64) for b in r.column(c).to_pylist()] for c in ("xs", "ps"))
        common = [shared(a, b) for a, b in zip(x, y)]
        yield batch(DISTANCE, {"p": r.column("p"), "v": r.column("v"), "shared": common, "all": [len(a) + len(b) - s for a, b, s in zip(x, y, common)]})


def screened(n: np.ndarray, out: np.ndarray, side: np.ndarray, outlines: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which of a region's points may be within the radius of another, by size and outline; two that the pivot links already, or that meet elsewhere, don't count."""
    sizes = np.array([len(o) for o in outlines])
    at: dict[int, np.ndarray] = {}
    matrix: dict[int, np.ndarray] = {}
    for c in np.unique(sizes):  # linked sets' outlines are of one size or of neighbouring ones
        at[c] = np.flatnonzero((sizes == c) | (sizes == 2 * c))
        matrix[c] = np.stack([folded(outlines[i], c) for i in at[c]])
    hit = np.zeros(len(n), bool)
    for i in range(len(n)):
        for c in {int(sizes[i]), int(sizes[i]) // 2} & at.keys():
            j = at[c]
            row = int(np.searchsorted(j, i))
            meet = (j > i) & (out[j] | out[i]) & ((side[j] != side[i]) | (side[i] == HOME))
            some = np.flatnonzero(meet & rule.linked(np.minimum(n[i], n[j]), np.maximum(n[i], n[j])))
            if not len(some):
                continue
            bits = np.bitwise_count(matrix[c][some] ^ matrix[c][row]).sum(1).astype(np.int64)
            near = j[some[(100 + rule.percent) * bits <= (100 - rule.percent) * (n[j[some]] + n[i])]]
            hit[near] = True
            hit[i] |= len(near) > 0
    return hit


def _screen(rule: Rule):
    def screen(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hit = screened(rows["n"].to_numpy(), rows["out"].to_numpy(), rows["side"].to_numpy(), _outlines(rows["xo"]), rule)
        found = rows.filter(pa.array(hit)).group_by("v", use_threads=False).aggregate([("n", "sum"), ("out", "any"), ("side", "max")])
        return pa.table([pa.repeat(key[0], len(found)), found["v"], found["n_sum"], found["out_any"], found["side_max"]], schema=MEMBER)

    return screen


def join_region(ids: list[int], sets: list[np.ndarray], rule: Rule, pivots: int = 8) -> list[tuple[int, int]]:
    """Links that connect all linked points of one region: pivots in turn, candidates thinned by size, by the triangle inequality and by what is connected already."""
    n = len(ids)
    sizes, group = np.array([len(s) for s in sets]), np.arange(n)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    known: list[np.ndarray] = []
    out = []
    for i in range(n):
        low, high = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        open_ = (np.arange(n) > i) & (group != group[i]) & rule.linked(low, high)
        for d in known:
            open_ &= np.abs(d - d[i]) <= rule.radius + 1e-9
        if not open_.any():
            continue
        pivot = len(known) < pivots
        if pivot:
            common = np.bincount(owner[_member(flat, sets[i])], minlength=n)
            known.append(1 - common / (sizes + sizes[i] - common))
        else:
            common = np.zeros(n, np.int64)
            for j in np.flatnonzero(open_):
                common[j] = shared(sets[i], sets[j])
        for j in np.flatnonzero(open_ & rule.linked(common, sizes + sizes[i] - common)):
            if group[i] != group[j]:
                out.append((ids[i], ids[j]))
                group[group == group[j]] = group[i]
    return out


def _member(flat: np.ndarray, s: np.ndarray) -> np.ndarray:
    at = np.searchsorted(s, flat)
    at[at == len(s)] = 0
    return s[at] == flat


def _regions(rule: Rule):
    def region(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("v", "ascending")])
        sets = [np.frombuffer(b, np.uint64) for b in rows["xs"].to_pylist()]
        edges = join_region(rows["v"].to_pylist(), sets, rule)
        return pa.table({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, schema=EDGE)

    return region


def _with_sets(wanted: DataFrame, source: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(v, set) of the wanted points, and of the few more that the filter lets pass."""
    wanted = scratch.written(wanted.select("v").distinct(), "wanted")
    words = build_filter(wanted, F.xxhash64("v"), filter_bits(wanted.count()))
    return scratch.written(source.where("doc_id is not null").mapInArrow(_sets(rule, words), "v long, set binary"), "sets")


def _distances_of(pairs: DataFrame, source: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(p, v, d, linked): exact distances of the pairs (p, v)."""
    sets = _with_sets(pairs.select("v").unionByName(pairs.select(F.col("p").alias("v"))), source, rule, scratch)
    met = pairs.join(sets.withColumnRenamed("set", "xs"), "v").join(sets.select(F.col("v").alias("p"), F.col("set").alias("ps")), "p")
    met = met.mapInArrow(_distances, "p long, v long, shared long, all long")
    return scratch.written(met.select("p", "v", (1 - F.col("shared") / F.col("all")).alias("d"), F.expr(f"100 * shared >= {rule.percent} * all").alias("linked")), "met")


def _open_rows(known: DataFrame, rule: Rule) -> DataFrame:
    """Of a region's points, those beyond the radius of its pivot and those within the triangle window of one that is. known: (p, v, n, d, out, side)."""
    nearest = known.where("out").groupBy("p").agg(F.min("d").alias("nearest"))
    return known.join(nearest, "p").where(F.col("out") | (F.col("d") >= F.col("nearest") - rule.radius - 1e-9)).select(MEMBER.names)


def _joined_here(rest: DataFrame, outlines: DataFrame, source: DataFrame, rule: Rule, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Links of the regions that one task can join, and the rows of the others, one for each id. rest: MEMBER rows; outlines: (v, n, xo)."""
    sizes = scratch.written(rest.groupBy("p").agg(F.count("*").alias("points")).where("points > 1"), "sizes")
    kept = rest.join(sizes.where(F.col("points") <= SCREENED_POINTS).select("p"), "p").drop("n").join(outlines, "v").groupBy("p").applyInArrow(_screen(rule), MEMBER_TYPE)
    kept = scratch.written(kept, "screened")
    left = scratch.written(kept.groupBy("p").agg(F.count("*").alias("points"), F.sum("n").alias("shingles")), "left")
    small = (F.col("points") <= 2) | (F.col("points") <= REGION_POINTS) & (F.col("shingles") <= REGION_SHINGLES)
    held = scratch.written(kept.join(left.where(small).select("p"), "p").select("p", "v"), "held")
    edges = []
    if not held.isEmpty():
        sets = _with_sets(held, source, rule, scratch).withColumnRenamed("set", "xs")
        edges.append(scratch.written(held.join(sets, "v").groupBy("p").applyInArrow(_regions(rule), "a long, b long"), "links"))
    large = rest.join(sizes.where(F.col("points") > SCREENED_POINTS).select("p"), "p").select(MEMBER.names)
    large = large.unionByName(kept.join(left.where(~small).select("p"), "p").select(MEMBER.names))
    return edges, scratch.written(large.groupBy("p", "v").agg(F.max("n").alias("n"), F.max("out").alias("out"), F.max("side").alias("side")), "large")


def _cells(rows: DataFrame, source: DataFrame, rule: Rule, scratch: Scratch, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts large regions by several pivots each: (links to the pivots, rows of the cells, rows of regions that cells do not make easier).

    A region with an id of several texts, whose distance to a pivot is not one number, is among the latter.
    """
    pivots = scratch.written(rows.groupBy("p", F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(CELL_PIVOTS)).alias("k")).agg(F.min("v").alias("q")).select("p", "q"), "cell-pivots")
    pairs = scratch.written(rows.join(pivots, "p").select("p", "q", "v", "n"), "cell-pairs")
    exact = _distances_of(pairs.where("q <> v").select(F.col("q").alias("p"), "v").distinct(), source, rule, scratch)
    edges = exact.where("linked").select(F.col("p").alias("a"), F.col("v").alias("b"))
    exact = exact.groupBy("p", "v").agg(F.min("d").alias("d"), (F.min("d") < F.max("d")).alias("several"), F.max("linked").alias("linked"))
    at = pairs.join(exact.withColumnRenamed("p", "q"), ["q", "v"], "left").select("p", "q", "v", "n", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("linked", F.lit(True)).alias("linked"), F.coalesce("several", F.lit(False)).alias("several"))
    at = scratch.written(at, "cell-distances")
    home = at.groupBy("p", "v").agg(F.min(F.struct("d", "q")).alias("home"))
    cell = F.xxhash64("p", "q", F.lit(turn))
    of = at.join(home, ["p", "v"]).where(F.col("d") <= F.col("home.d") + 2 * rule.radius + 1e-9)
    known = of.select(cell.alias("p"), F.col("p").alias("parent"), "v", "n", "d", (~F.col("linked")).alias("out"), F.when(F.col("q") == F.col("home.q"), HOME).otherwise(AWAY).alias("side"))
    known = scratch.written(known, "cell-rows")
    rest = scratch.written(_open_rows(known, rule), "cell-rest")
    within = rest.groupBy("p").agg(F.count("*").cast("double").alias("points")).join(known.select("p", "parent").distinct(), "p")
    cost = within.groupBy("parent").agg(F.sum(F.col("points") * F.col("points")).alias("pairs"))
    whole = rows.groupBy(F.col("p").alias("parent")).agg(F.count("*").cast("double").alias("points"))
    costly = whole.join(cost, "parent").where("2 * pairs > points * points").select("parent")
    stuck = scratch.written(costly.unionByName(at.where("several").select(F.col("p").alias("parent"))).distinct(), "stuck")
    easier = known.select("p", "parent").distinct().join(stuck, "parent", "left_anti").select("p")
    easy, hard = rest.join(easier, "p").select(MEMBER.names), rows.join(stuck.withColumnRenamed("parent", "p"), "p").select(MEMBER.names)
    return edges, scratch.written(easy, "cells"), scratch.written(hard, "stuck-rows")


def _blocks(rows: DataFrame, turn: int) -> DataFrame:
    """Deals a region's points into blocks by a hash, and each pair of blocks out as a region of its own: every pair of points that was to meet meets in one of them."""
    most = F.max(F.when(F.col("side") == HOME, 1).otherwise(0)).alias("homes")
    sizes = rows.groupBy("p").agg(F.count("*").alias("points"), F.sum("n").alias("shingles"), most)
    wide = F.ceil(F.col("points") / (SCREENED_POINTS // 2 or 1))
    narrow = F.greatest(F.ceil(2 * F.col("points") / REGION_POINTS), F.ceil(2 * F.col("shingles") / REGION_SHINGLES))
    blocks = F.greatest(F.lit(2), F.when(F.col("points") > SCREENED_POINTS, wide).otherwise(narrow)).cast("int")
    dealt = rows.join(sizes.select("p", "homes", blocks.alias("m")), "p").withColumn("i", F.pmod(F.xxhash64("v", F.lit(turn)), F.col("m")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    # with points of kind HOME the region is met with itself; else one side's blocks meet the other's
    own = F.when(F.col("i") == F.col("j"), HOME).when(F.col("i") < F.col("j"), AWAY).otherwise(OTHER)
    low, high = F.least("i", "j"), F.greatest("i", "j")
    first = F.when(F.col("homes") == 1, low).when(F.col("side") == AWAY, F.col("i")).otherwise(F.col("j"))
    second = F.when(F.col("homes") == 1, high).when(F.col("side") == AWAY, F.col("j")).otherwise(F.col("i"))
    return dealt.select(F.xxhash64("p", first, second, F.lit(turn)).alias("p"), "v", "n", "out", F.when(F.col("homes") == 1, own).otherwise(F.col("side")).alias("side"))


def links(points: DataFrame, source: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(a, b): links between points that connect every pair within the radius. points: (v, n, prefix, outline); source: (doc_id, text)."""
    first = points.select("v", "prefix").mapInArrow(_entries(None), "h long, v long")
    pivots = scratch.written(first.groupBy("h").agg(F.min("v").alias("p"), F.count("*").alias("c")).where("c > 1").select("h", "p"), "pivots")
    edges = [points.sparkSession.createDataFrame([], "a long, b long")]
    if pivots.isEmpty():
        return edges[0]
    words = build_filter(pivots, F.col("h"), filter_bits(pivots.count()), 1)
    entries = points.select("v", "prefix").mapInArrow(_entries(words), "h long, v long")
    x = points.select("v", "n", F.col("outline").alias("xo"))
    y = points.select(F.col("v").alias("p"), F.col("n").alias("pn"), F.col("outline").alias("po"))
    pairs = scratch.written(entries.join(pivots, "h").where("v <> p").select("p", "v").distinct(), "pairs")
    bounds = scratch.written(pairs.join(x, "v").join(y, "p").mapInArrow(_bounds(rule), "p long, v long, n long, d double, near boolean"), "bounds")
    met = _distances_of(bounds.where("near").select("p", "v"), source, rule, scratch)
    edges.append(met.where("linked").select(F.col("p").alias("a"), F.col("v").alias("b")))
    known = bounds.join(met.select("p", "v", F.col("d").alias("exact"), "linked"), ["p", "v"], "left")
    known = known.select("p", "v", "n", F.coalesce("exact", "d").alias("d"), (~F.coalesce("linked", F.lit(False))).alias("out"), F.lit(HOME).alias("side"))
    rest, turn = scratch.written(_open_rows(scratch.written(known, "known"), rule), "rest"), 0
    by_block: list[DataFrame] = []
    while True:
        found, large = _joined_here(rest, x, source, rule, scratch)
        edges += found
        if large.isEmpty():
            break
        turn += 1
        to_pivots, rest, stuck = _cells(large, source, rule, scratch, turn)
        edges.append(to_pivots)
        by_block.append(stuck)
    while by_block:
        turn += 1
        rest = by_block[0]
        for more in by_block[1:]:
            rest = rest.unionByName(more)
        found, large = _joined_here(scratch.written(_blocks(rest, turn), "blocks"), x, source, rule, scratch)
        edges += found
        by_block = [] if large.isEmpty() else [large]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def ngram_components(docs: DataFrame, *, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", frequent_from: int = 16, most_frequent: int = 400_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        counted = source.select("text").mapInArrow(_count(rule), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent_from)
        frequent = np.sort(counted.orderBy(F.desc("n"), "h").limit(most_frequent).select("h").toArrow()["h"].to_numpy().view(np.uint64))
        signed = scratch.written(source.mapInArrow(_signatures(rule, frequent), "doc_id long, n long, digest string, prefix binary, outline binary"), "signed")
        real = signed.where("n > 0 and doc_id is not null")
        points = real.where("prefix is not null").select(F.col("doc_id").alias("v"), "n", "digest", "prefix", "outline")
        roots = connected(links(points.drop("digest"), source, rule, scratch))
        # copies of one set are one class, whichever of them stood for it in each task
        rooted = points.select("digest", "v").join(roots, "v", "left").groupBy("digest").agg(F.min(F.coalesce("root", "v")).alias("root"))
        classes = scratch.written(real.groupBy("digest").agg(F.min("doc_id").alias("least")).join(rooted, "digest"), "classes")
        named = classes.select("digest", "root").join(classes.groupBy("root").agg(F.min("least").alias("component")), "root").select("digest", "component")
        apart_ = F.col("doc_id").isNull() | (F.col("n") == 0)
        component = F.when(apart_, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
        return written(signed.select("doc_id", "n", "digest").join(scratch.written(named, "named"), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), component), "components")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), rule=Rule(4, 85))


SQL = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from words),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from reach r join edges e on r.doc_id = e.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id from sets s join (select doc_id, min(root) as component_id from reach group by doc_id) r using (doc_id)
"""
