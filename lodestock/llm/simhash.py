"""SimHash near-duplicate detection: an inverted index of positional bytes with count filtering.

A fingerprint is eight positional bytes. Two that differ in at most `bits` (3) bits share at least 8 - 3 = 5 of them: that is the
guaranteed minimum of matches. Lists of single positional bytes would hold a 256th of all documents each and pair them all, so the
index is kept by the first five positional bytes that a pair shares: a fingerprint is listed under each of the 56 choices of five
positions with its bytes there, and every pair that reaches the minimum meets in a list. In a list the shared positional bytes of a pair are
tallied from one XOR, pairs below the minimum go, and what is left is verified by its differing bits. A short list hands on a pair only
where the list's positions are the first five it shares, so that a pair is handed on once.

Equal fingerprints are one entry, so no list grows with copies. A list has one entry for each choice of the three bytes left at most
(2^24, 128 MB) whatever the input, and one in 56 of all entries at most. Lists of more than SMALL entries hand on links that connect what
pairwise links would (at most one for each entry and merging round), not all pairs; those of more than CROWDED look up each of the
2,324 ways to change up to three of the 24 bits in one table instead of comparing pairs, linear in the list.

Bit b of the fingerprint is set if it is in over half of the XXH64 values (seed 42) of the text's word shingles, repeats included;
A-Z are lower-cased, words parted by space and U+0009 to U+000D. A text of fewer words than a shingle has one, of all its words.
Nulls: a null or blank text has fingerprint zero and is linked like any other; a null id is in its fingerprint's component, but never its name
(null where no row of it has an id). Components are those of fingerprints: rows that share an id are apart if their texts are. Repeated rows
give repeated results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch, connected, each_text, release, table, written

#: Shingles hashed at a time.
AT_ONCE = 1 << 14
#: Entries of a list up to which all its pairs are compared side by side with other lists, and beyond which its entries' neighbours are looked up.
SMALL, CROWDED = 32, 1 << 15
BITS, BYTES = 3, 8
SHARED = BYTES - BITS
#: The choices of five positions, the mask of each, and the same by which positions a pair shares.
CHOICES = list(combinations(range(BYTES), SHARED))
MASKS = np.array([sum(0xFF << 8 * p for p in c) for c in CHOICES], dtype=np.uint64)
FIRST = np.full(256, -1, np.int64)
for _shared in range(256):
    _at = tuple(p for p in range(BYTES) if _shared >> p & 1)
    if len(_at) >= SHARED:
        FIRST[_shared] = CHOICES.index(_at[:SHARED])
SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int64())])
ENTRY = pa.schema([("list", pa.int64()), ("f", pa.int64())])
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, words: int = 3) -> tuple[int, int]:
    """Number of shingles and fingerprint."""
    parts = text.lower().split()
    if not parts:
        return 0, 0
    if len(parts) <= words:
        return 1, xxhash.xxh64_intdigest(b" ".join(parts), 42)
    n, digest = len(parts) - words + 1, xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for a in range(0, n, AT_ONCE):
        b = min(n, a + AT_ONCE)
        line = b" ".join(parts[a : b + words - 1])
        size = np.fromiter(map(len, parts[a : b + words - 1]), np.int64, b - a + words - 1)
        end = np.cumsum(size + 1) - 1
        start = end - size
        h = np.fromiter((digest(line[s:e], 42) for s, e in zip(start[: b - a].tolist(), end[words - 1 :].tolist())), np.uint64, b - a)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return n, int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _sign(words: int):
    def sign(rows):
        for r in each_text(rows):
            found = [fingerprint(t, words) for t in as_bytes(r.column(1))]
            yield batch(SIGNED, {"doc_id": r.column(0), "n": [n for n, _ in found], "f": np.array([f for _, f in found], dtype=np.uint64).view(np.int64)})

    return sign


def list_of(f: np.ndarray, choice: int) -> np.ndarray:
    """A list's number: the choice of positions above its five bytes."""
    out = np.full(len(f), choice << 8 * SHARED, np.uint64)
    for k, p in enumerate(CHOICES[choice]):
        out |= ((f >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * k)
    return out


def _entries(rows):
    for r in rows:
        for at in range(0, r.num_rows, 1 << 14):
            f = r.column(0).slice(at, 1 << 14).to_numpy().view(np.uint64)
            for c in range(len(CHOICES)):
                yield batch(ENTRY, {"list": list_of(f, c).view(np.int64), "f": f.view(np.int64)})


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """For XORs of fingerprints, which positional bytes are shared, as a mask of eight bits."""
    return np.packbits(x.view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little")[:, 0]


def linked(x: np.ndarray) -> np.ndarray:
    """Count filter, then verification: at least five positional bytes shared, at most three bits different."""
    ok = np.bitwise_count(shared_bytes(x)) >= SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def side_by_side(lists: np.ndarray, f: np.ndarray, last: np.ndarray):
    """Links within many short lists at once, each where the list's positions are the first that the pair shares. Entries come sorted by list; last: the end of each one's list."""
    i, step = np.arange(len(f)), 1
    while True:
        going = i + step < last
        i, last = i[going], last[going]
        if not len(i):
            return
        x = f[i] ^ f[i + step]
        hit = np.flatnonzero(linked(x))
        hit = hit[FIRST[shared_bytes(x[hit])] == lists[i[hit]] >> 8 * SHARED]
        if len(hit):
            yield f[i[hit]], f[i[hit] + step]
        step += 1


class Forest:
    """Labels of a list's entries; only links between different labels are kept."""

    def __init__(self, f: np.ndarray):
        self.f, self.label, self.links = f, np.arange(len(f)), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        _, once = np.unique(low * len(self.f) + high, return_index=True)
        self.links.append((self.f[i[once]], self.f[j[once]]))
        root = np.arange(len(self.f))
        low, high = low[once], high[once]
        while True:  # min hooking, then jumping to the roots
            x, y = root[low], root[high]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        self.label = root[self.label]


def long_list(f: np.ndarray, choice_mask: int) -> Forest:
    """Links that connect all linked entries of one list; `choice_mask`: the bits that they share."""
    forest, n = Forest(f), len(f)
    if n <= CROWDED:
        rows = max(1, (1 << 21) // n)
        for a in range(0, n, rows):
            i, j = np.nonzero(np.bitwise_count(f[a : a + rows, None] ^ f[None, a:]) <= BITS)
            up = j > i
            forest.add(a + i[up], a + j[up])
        return forest
    free = [b for b in range(64) if not choice_mask >> b & 1]
    packed = np.zeros(n, np.int64)
    for k, b in enumerate(free):
        packed |= ((f >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(free), -1, np.int32)
    place[packed] = np.arange(n)
    for k in range(1, BITS + 1):
        for change in combinations(range(len(free)), k):
            j = place[packed ^ sum(1 << b for b in change)]
            i = np.flatnonzero(j > np.arange(n))
            forest.add(i, j[i])
    return forest


def links_of(lists: np.ndarray, f: np.ndarray):
    """(a, b) arrays of links within lists, which come sorted and whole."""
    begin = np.flatnonzero(np.diff(lists, prepend=-1))
    size = np.diff(begin, append=len(lists))
    some = np.repeat((size > 1) & (size <= SMALL), size)
    ends = np.repeat(np.cumsum(np.where((size > 1) & (size <= SMALL), size, 0)), size)[some]
    yield from side_by_side(lists[some], f[some], ends)
    for g in np.flatnonzero(size > SMALL).tolist():
        some = f[begin[g] : begin[g] + size[g]]
        yield from long_list(some, int(MASKS[lists[begin[g]] >> 8 * SHARED])).links


def _meet(rows):
    """Links of lists that come sorted, each whole in one task; one that goes on in the next batch waits for it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links():
        lists, f = (np.concatenate(x) for x in zip(*held))
        for a, b in links_of(lists, f):
            yield batch(EDGE, {"a": a.view(np.int64), "b": b.view(np.int64)})

    for r in rows:
        if not r.num_rows:
            continue
        lists, f = r.column(0).to_numpy(), r.column(1).to_numpy().view(np.uint64)
        cut = int(np.searchsorted(lists, lists[-1], "left"))
        if cut or held and held[-1][0][-1] != lists[0]:
            held.append((lists[:cut], f[:cut]))
            yield from links()
            held.clear()
        held.append((lists[cut:], f[cut:]))
    if held:
        yield from links()
    release()


def simhash_components(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, fingerprint, component_id), one row for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        signed = scratch.written(source.mapInArrow(_sign(words), "doc_id long, n long, f long"), "signed")
        classes = scratch.written(signed.groupBy("f").agg(F.min("doc_id").alias("least")), "classes")
        entries = classes.select("f").mapInArrow(_entries, "list long, f long")
        met = scratch.written(entries.repartition("list").sortWithinPartitions("list").mapInArrow(_meet, "a long, b long"), "links")
        roots = connected(met)
        rooted = classes.join(roots.withColumnRenamed("v", "f"), "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
        rooted = scratch.written(rooted, "rooted")
        named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f", "component_id")
        hexed = F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint")
        return written(signed.join(scratch.written(named, "named"), "f").select("doc_id", F.col("n").alias("n_shingles"), hexed, "component_id"), "simhash")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
