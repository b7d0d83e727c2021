"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, parted by space and U+0009 to U+000D); a line without a word is none. Of two
lines whose Jaccard similarity is at least `percent` the later one goes, by document id, then place; a line goes if any earlier
line matches it, whether or not that one goes too.

Words are counted over all documents, and every line's words are ordered by rarity. A line's prefix, its rarest words, holds
the first word, in that order, that it shares with any line that matches it. Each line is dealt out by the words of its prefix;
words that occur once are left out, as nothing can meet them. Lines that meet under a word are held against each other if their
sizes (length filter), the word's places in both (positional filter) and outlines of both sets allow a match, and what
is left is verified on the whole word sets. Equal sets are folded where they meet, so that copies are dealt out once a task.

A word of more than `cold` occurrences would bring together ever more lines as a corpus grows. It is dealt out with the next
word that both lines share instead, which the prefix longer by one holds, and with a third or fourth (in longer lines, which have more combinations, a third or none) while
the words' frequencies let more than `cold` lines be expected under them; lines of about the size where the rule changes follow both. In lines of LONG words or more even pairs would be too many;
there the words are parted by hash: lines that match differ in at most two words of some part, hence agree on two of its four
quarters, and a line is dealt out by the six pairs of quarters of each part, so that its keys grow in proportion to its words. Lines that share such words more often than their
frequencies say (more than `hot` of them), and lines that have more than `crowd` likely partners under one key (templates), leave their task as rows. Of these the
earliest of each key is held against the others, round by round, and only lines that matched none are joined with the earlier ones of their key.

Nulls: a null text stays null; rows with a null id are left as they are and match nothing. Rows that share an id count as one
document: lines at the same place are one line, which stays if any of its texts stays. A document all of whose lines go
keeps its row with an empty text. Ties in similarity are matches. An empty table gives an empty result. Columns named n_lines, n_removed or removed
are replaced; no other name clashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, as_bytes, batch, build_filter, each_text, filter_bits, free_name, hashed, in_filter, release, swept, table, written
from .words import Words, grouped, mixed

#: Cells of the table of word counts, which is all that any process holds of them (one byte each: the logarithm), and cells sent at a time.
#: Words that share a cell count together, which costs speed at most.
CELLS, BLOCK = 1 << 23, 1 << 20
#: Levels of a count between one power of two and the next.
FINE = 5
#: Tasks whose counts are added up in one round.
FAN = 64
#: From so many words on a line's frequent words are dealt out by parts, not by combinations; words of a key at most in lines of at least, and fewer than, so many words.
LONG = 160
DEPTHS = ((4, 0, 40), (3, 40, 80), (2, 80, LONG), (1, LONG, 1 << 62))
#: Quarters of a part, and the pairs of them.
QUARTERS, HALVES = 4, np.array([(a, b) for a in range(4) for b in range(a + 1, 4)])
#: Sets of at most so many words carry an outline of 64 cells, larger ones one of 128.
NARROW_WORDS = 56
#: Keys that a task holds before it hands them on, and keys that one group is meant to hold.
HELD, GROUP_KEYS = 300_000, 300_000
#: Rounds in which the earliest line of a hot key is held against all others.
PIVOTS = 2
COUNTS = pa.schema([("block", pa.int64()), ("slot", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
LINE = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("line", "<i8"), ("n", "<i8")])
PLACE = np.dtype([("doc", "<i8"), ("line", "<i8")])
#: key, digest and outline of the set, its size, and the most words that it can share with another under this key. Sizes stop at 65535: nothing is ruled out by those.
NARROW = np.dtype([("key", "<u4"), ("d", "<u8"), ("b", "<u8"), ("n", "<u2"), ("rest", "<u2")])
WIDE = np.dtype([("key", "<u4"), ("d", "<u8"), ("b", "<u8"), ("c", "<u8"), ("n", "<u2"), ("rest", "<u2")])
DEALT = pa.schema([("block", pa.int64()), ("lines", pa.binary()), ("gone", pa.binary()), ("narrow", pa.binary()), ("wide", pa.binary())])
#: What a group finds: a set and its first line, a line that repeats an earlier one, a pair of digests, a set under a hot key.
SET, GONE, PAIR, HOT = range(4)
FOUND = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in "abcdef"])
FOUND_COLUMNS = "kind int, a long, b long, c long, d long, e long, f long"
TOKENS = pa.schema([("doc_id", pa.int64()), ("line", pa.int64()), ("d1", pa.int64()), ("tokens", pa.binary())])
#: What names a set: its digest, and the place of its first line.
PLACED = ("d1", "doc_id", "line")
GOLD = np.uint64(0x9E3779B97F4A7C15)


def needed(n, percent: int):
    """Words that a set of n shares with any set that matches it, at least."""
    return -(-n * percent // 100)


class Lines:
    """Words of the lines of many texts at once."""

    def __init__(self):
        self.words = Words()

    def raw(self, texts: list[bytes]):
        """Word hashes; per word its line's number; per line with a word its text and its place in it."""
        data = b"\n".join(texts).lower()
        h, starts, _ = self.words.split(data)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        before = np.cumsum([0] + [t.count(b"\n") + 1 for t in texts])
        number = np.searchsorted(ends, starts)
        new = np.append(True, number[1:] != number[:-1])[: len(number)]
        used = number[new]
        of_text = np.searchsorted(before, used, side="right") - 1
        return h, np.cumsum(new) - 1, of_text, used - before[of_text]

    def sets(self, texts: list[bytes], levels: np.ndarray | None = None):
        """text, place and size of each line with a word; then, line after line, its different words, rarest first by `levels`, their levels, and their line's number."""
        for a, b in grouped(texts):
            h, line, of_text, place = self.raw(texts[a:b])
            level = np.zeros(len(h), np.uint8) if levels is None else levels[(h & np.uint64(CELLS - 1)).astype(np.int64)]
            order = _order(line, level, h)
            h, line, level = h[order], line[order], level[order]
            new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))[: len(h)]
            h, line, level = h[new], line[new], level[new]
            yield of_text + a, place, np.bincount(line, minlength=len(place)), h, level, line


def _order(line: np.ndarray, level: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by line, level and hash; one sort of one number if that tells all of them apart."""
    if len(h) and line[-1] < 1 << 24:
        one = line.astype(np.uint64) << np.uint64(40) | level.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)
        order = np.argsort(one)
        one, sorted_h = one[order], h[order]
        if not ((one[1:] == one[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return order
    return np.lexsort((h, level, line))


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for no occurrence, 1 for one, then the logarithm."""
    return np.minimum(np.where(counts > 0, 1 + np.rint(FINE * np.log2(np.maximum(counts, 1))), 0), 255).astype(np.uint8)


def _packed(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted cell numbers as gaps, and their counts, compressed."""
    return zlib.compress(np.diff(cells, prepend=0).astype(np.uint32).tobytes(), 1), zlib.compress(counts.astype(np.uint64).tobytes(), 1)


def _count(batches):
    """Occurrences of a task's words by cell."""
    words, counts = Words(), np.zeros(CELLS, np.uint32)
    for r in each_text(batches):
        texts = as_bytes(r.column(0))
        for a, b in grouped(texts):
            h, _, _ = words.split(b"\n".join(texts[a:b]).lower())
            np.add.at(counts, (h & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
    rows, slot = [], TaskContext.get().partitionId()
    for block in range(CELLS // BLOCK):
        some = counts[block * BLOCK : (block + 1) * BLOCK]
        cells = np.flatnonzero(some)
        if len(cells):
            rows.append((block, slot, *_packed(cells, some[cells])))
    if rows:
        yield batch(COUNTS, dict(zip(COUNTS.names, zip(*rows))))


def _sum(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint64)
    for cells, counts in zip(parts["cells"], parts["counts"]):
        total[np.cumsum(np.frombuffer(zlib.decompress(cells.as_py()), np.uint32), dtype=np.int64)] += np.frombuffer(zlib.decompress(counts.as_py()), np.uint64)
    cells = np.flatnonzero(total)
    cells, counts = _packed(cells, total[cells])
    return pa.table({"block": [key[0].as_py()], "slot": [key[1].as_py()], "cells": [cells], "counts": [counts]}, schema=COUNTS)


def _level(batches):
    for r in batches:
        rows = []
        for block, cells, counts in zip(*(r.column(c).to_pylist() for c in ("block", "cells", "counts"))):
            n = np.zeros(BLOCK, np.uint64)
            n[np.cumsum(np.frombuffer(zlib.decompress(cells), np.uint32), dtype=np.int64)] = np.frombuffer(zlib.decompress(counts), np.uint64)
            rows.append((block, int(n.sum()), zlib.compress(level_of(n).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], names=["block", "n", "levels"])


def word_levels(source: DataFrame, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Levels of the words' counts over all documents (CELLS bytes, whatever the input), and how many words there are."""
    kind = "block long, slot long, cells binary, counts binary"
    counts = source.select("text").mapInArrow(_count, kind)
    while True:
        counts = counts.withColumn("slot", F.floor(F.col("slot") / FAN).cast("long"))
        counts = scratch.written(counts.groupBy("block", "slot").applyInArrow(_sum, kind), "counts")
        if not (counts.agg(F.max("slot")).first()[0] or 0):
            break
    levels, total = np.zeros(CELLS, np.uint8), 0
    for part in counts.mapInArrow(_level, "block long, n long, levels binary").toArrow().to_pylist():
        levels[part["block"] * BLOCK : (part["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(part["levels"]), np.uint8)
        total += part["n"]
    return levels, total


def keys_of(n: np.ndarray, h: np.ndarray, level: np.ndarray, line: np.ndarray, some: np.ndarray, percent: int, cold: int, lines: float):
    """key, line's number and most shared words for each key under which the lines `some` (a mask) are dealt out. Of two lines that match, both have the key of their first shared words."""
    out = [part_keys(n, h, level, line, some & (n >= needed(LONG, percent)), percent, cold, lines)]
    for deepest, least, below in DEPTHS:
        own = some & (n >= least) & (n < below)
        beside = some & (n >= needed(least, percent)) & (n < least) & (deepest > 1)  # long lines and those beside them meet by parts
        for mask, cut_only in ((own, False), (beside, True)):
            if mask.any():
                out += _combinations(n, h, level, line, mask, percent, cold, lines, deepest, cut_only)
    return tuple(np.concatenate(x) for x in zip(*out))


def _combinations(n: np.ndarray, h: np.ndarray, level: np.ndarray, line: np.ndarray, some: np.ndarray, percent: int, cold: int, lines: float, deepest: int, cut_only: bool):
    """The keys of prefix words and, where they are frequent, of up to `deepest` words; with `cut_only` those alone that would have been lengthened further."""
    starts, must = np.cumsum(n) - n, needed(n, percent)
    place = np.arange(len(h)) - starts[line]
    last = np.flatnonzero((place <= (n - must)[line]) & (level > 1) & some[line])
    key, expected = mixed(h[last]), np.exp2((level[last] - 1.0) / FINE)
    out = []
    for depth in range(1, deepest + 1):
        more_words = (expected > cold) & (depth < must[line[last]])
        on = more_words if depth < deepest else np.zeros(len(last), bool)
        rest = n[line[last]] - place[last] - 1 + depth
        # a match so small that it may share no more words is met here
        here = ~on | (needed(must, percent)[line[last]] <= depth)
        if cut_only:
            here &= more_words & (depth == deepest)
        elif deepest == 1:  # frequent words of long lines are dealt out by parts
            here &= ~more_words
        out.append((key[here], line[last[here]], rest[here]))
        last, key, expected = last[on], key[on], expected[on]
        more = np.minimum(n, n - must + 1 + depth)[line[last]] - place[last] - 1
        many = np.repeat(np.arange(len(last)), more)
        step = np.arange(len(many)) - np.repeat(np.cumsum(more) - more, more) + 1
        last, key, expected = last[many] + step, key[many], expected[many]
        key, expected = mixed(key * GOLD + h[last]), expected * np.exp2((level[last] - 1.0) / FINE) / lines
    return out


def size_classes(most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size of each class of long lines; how many parts its lines have, and how many of these hold at most two words by which two lines that match differ.

    Of two lines that match, the larger one is of the smaller one's class or the next.
    """
    least = [needed(LONG, percent)]
    while least[-1] <= most:
        least.append(least[-1] * 100 // percent + 2)
    bound = np.array(least)
    small = bound[1:] - 1
    differ = (100 - percent) * (small + 100 * small // percent) // (100 + percent)
    parts = differ // 3 + 1
    parts += 1 + parts // 8
    return bound, parts, parts - differ // 3


def part_keys(n: np.ndarray, h: np.ndarray, level: np.ndarray, line: np.ndarray, some: np.ndarray, percent: int, cold: int, lines: float):
    """Like keys_of, for long lines by parts. Two lines that match have a key in common.

    A key under which more than `cold` lines are expected is left out by a line that has fewer parts with such a key than there are parts
    with at most two differing words: one of those is then met by another key, in either line, since equal quarters are expected alike.
    """
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, must = np.cumsum(n) - n, needed(n, percent)
    first_words = np.flatnonzero(some[line] & (np.arange(len(h)) - starts[line] <= (n - must)[line]) & (np.exp2((level - 1.0) / FINE) > cold))
    some = np.zeros(len(n), bool)
    some[line[first_words]] = True
    if not some.any():
        return nothing
    bound, parts, sound = size_classes(int(n[some].max()), percent)
    own = np.searchsorted(bound, n, "right") - 1
    chosen, scale, out = np.flatnonzero(some), np.log2(max(lines, 2.0)), []
    words = np.flatnonzero(some[line])
    local = np.searchsorted(chosen, line[words])
    for back in (0, 1):
        kind = own[chosen] - back
        use = kind >= 0
        mine, of = chosen[use], np.cumsum(use) - 1
        if not len(mine):
            continue
        kind, w = kind[use], words[use[local]]
        at = of[local[use[local]]]
        p = parts[kind]
        first = np.cumsum(p) - p
        spread = mixed(h[w] + kind[at].astype(np.uint64) * GOLD)
        cell = (first[at] + (spread % p[at].astype(np.uint64)).astype(np.int64)) * QUARTERS + ((spread >> np.uint64(40)) % np.uint64(QUARTERS)).astype(np.int64)
        total = int(p.sum())
        digest = np.zeros(total * QUARTERS, np.uint64)
        np.add.at(digest, cell, mixed(spread))
        count = np.bincount(cell, minlength=total * QUARTERS).reshape(total, QUARTERS)
        # whole numbers, so that equal quarters give equal expectations
        often = np.bincount(cell, level[w].astype(np.int64) - 1, minlength=total * QUARTERS).astype(np.int64).reshape(total, QUARTERS)
        digest = digest.reshape(total, QUARTERS)
        a, b = HALVES.T
        number = np.arange(total) - np.repeat(first, p)
        tag = mixed((np.repeat(kind, p).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64))[:, None] * np.uint64(8) + np.arange(len(HALVES), dtype=np.uint64))
        key = mixed((digest[:, a] + digest[:, b]) * GOLD + tag)
        weak = scale + (often[:, a] + often[:, b]) / FINE - (count[:, a] + count[:, b]) * scale > np.log2(cold)
        row = np.repeat(np.arange(len(mine)), p)
        weak_parts = np.bincount(row, weak.any(1), minlength=len(mine))
        take = ~weak | (weak_parts >= sound[kind])[row][:, None]
        i, j = np.nonzero(take)
        o = mine[row[i]]
        out.append((key[i, j], o, n[o]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else nothing


def _folded(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line of each set, and the places of the others."""
    lines = lines[np.lexsort((lines["line"], lines["doc"], lines["d2"], lines["d1"]))]
    new = np.append(True, (lines["d1"][1:] != lines["d1"][:-1]) | (lines["d2"][1:] != lines["d2"][:-1]))[: len(lines)]
    first = lines[new]
    own = first[np.cumsum(new) - 1]
    others = (lines["doc"] != own["doc"]) | (lines["line"] != own["line"])
    return first, _places(lines["doc"][others], lines["line"][others])


def _places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), PLACE)
    out["doc"], out["line"] = doc, line
    return out


def _deal(tables, percent: int, cold: int, blocks: int, words: int):
    """Lines and keys of all texts by block: a set's line by its digest, a key by itself."""

    def split(rows: np.ndarray, block: np.ndarray, name: str, out: dict[int, dict[str, bytes]]) -> None:
        order = np.argsort(block, kind="stable")
        rows, block = rows[order], block[order]
        used, at = np.unique(block, return_index=True)
        for b, i, j in zip(used.tolist(), at, [*at[1:], len(rows)]):
            out.setdefault(b, {})[name] = rows[i:j].tobytes()

    def flush(held: dict[str, list], turn: int) -> pa.RecordBatch:
        first, gone = _folded(np.concatenate(held["lines"]))
        out: dict[int, dict[str, bytes]] = {}
        split(first, (first["d1"] % np.uint64(blocks)).astype(np.int64), "lines", out)
        if len(gone):
            out.setdefault(turn % blocks, {})["gone"] = gone.tobytes()
        for name in ("narrow", "wide"):
            if held[name]:
                split(np.concatenate(held[name]), np.concatenate(held[f"{name}_block"]), name, out)
        return batch(DEALT, {"block": list(out), **{c: [x.get(c) for x in out.values()] for c in DEALT.names[1:]}})

    def deal(batches):
        reader, levels, task = Lines(), tables.value, TaskContext.get().partitionId()
        empty = lambda: {"lines": [], "narrow": [], "wide": [], "narrow_block": [], "wide_block": []}
        held, size, met, turn = empty(), 0, set(), task
        for r in each_text(batches):
            ids = r.column(0).to_numpy()
            for text, place, n, h, level, line in reader.sets(as_bytes(r.column(1)), levels):
                if not len(n):
                    continue
                starts = np.cumsum(n) - n
                spread = mixed(h)
                d1, d2 = np.add.reduceat(spread, starts), np.add.reduceat(mixed(spread + GOLD), starts)
                rows = np.zeros(len(n), LINE)
                rows["d1"], rows["d2"], rows["doc"], rows["line"], rows["n"] = d1, d2, ids[text], place, n
                held["lines"].append(rows)
                new = np.zeros(len(n), bool)
                for i, d in enumerate(d1.tolist()):
                    if d not in met:
                        met.add(d)
                        new[i] = True
                bit, upper = np.uint64(1) << (spread & np.uint64(63)), (spread >> np.uint64(6)) & np.uint64(1) == 1
                outline, half = np.bitwise_xor.reduceat(bit, starts), np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), starts)
                key, of, rest = keys_of(n, h, level, line, new, percent, cold, max(words / 32, 1))
                wide = n[of] > NARROW_WORDS
                for name, kind, mask in (("narrow", NARROW, ~wide), ("wide", WIDE, wide)):
                    k, o = key[mask], of[mask]
                    entries = np.zeros(len(k), kind)
                    entries["key"], entries["d"], entries["b"] = k & np.uint64((1 << 32) - 1), d1[o], outline[o]
                    entries["n"], entries["rest"] = np.minimum(n[o], 65535), np.minimum(rest[mask], 65535)
                    if name == "wide":
                        entries["c"] = half[o]
                    held[name].append(entries)
                    held[f"{name}_block"].append(((k >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64))
                size += len(key) + len(n)
            if size > HELD:
                yield flush(held, turn)
                held, size, met, turn = empty(), 0, set(), turn + 1
        if size:
            yield flush(held, turn)

    return deal


def _found(kind: int, *columns) -> pa.Table:
    rows = len(columns[0])
    arrays = [pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
    arrays += [pa.nulls(rows, pa.int64())] * (6 - len(arrays))
    return pa.Table.from_arrays([pa.array(np.full(rows, kind, np.int32)), *arrays], schema=FOUND)


def _near(percent: int, bits, n, m):
    """Whether sets of n and m words may match whose outlines differ in so many bits."""
    return (100 + percent) * bits.astype(np.int32) <= (100 - percent) * (n + m)


def pairs_within(entries: np.ndarray, wide: np.ndarray, percent: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of digests that may match, and which entries are crowded. Entries are sorted by key, then size, and held against those one, two ... places on, until no key has two lines of alike sizes so far apart.

    An entry is crowded that has more than `crowd` partners under its key, as have lines made from one template; pairs of two crowded entries are left out.
    """
    n, rest, b, c = entries["n"].astype(np.int32), entries["rest"].astype(np.int32), entries["b"].copy(), entries["c"].copy()
    keyed = entries["key"].astype(np.uint64) << np.uint64(16)
    largest = keyed | np.minimum(100 * n.astype(np.uint64) // np.uint64(percent), np.uint64(65535))
    at = np.arange(len(entries))
    far = np.searchsorted(keyed | entries["n"].astype(np.uint64), largest, side="right") - 1 - at  # how far an entry's partners reach
    na, ba, step = n, b, 0
    partners, crowded, out = np.zeros(len(entries), np.int64), np.zeros(len(entries), bool), [np.zeros((0, 2), np.int64)]
    while len(at):
        step += 1
        on = far >= step
        if not on.all():
            at, far, na, ba = at[on], far[on], na[on], ba[on]
        to = at + step
        ok = np.flatnonzero(_near(percent, np.bitwise_count(ba ^ b[to]), na, n[to]) | (n[to] == 65535))
        x, y = at[ok], to[ok]
        capped, both = n[y] == 65535, n[x] + n[y]
        ok = ((100 + percent) * np.minimum(rest[x], rest[y]) >= percent * both) & (entries["d"][x] != entries["d"][y])
        apart = np.bitwise_count(c[x] ^ c[y]).astype(np.int32) + np.bitwise_count(b[x] ^ c[x] ^ b[y] ^ c[y])
        ok &= ~(wide[x] & wide[y]) | _near(percent, apart, n[x], n[y])
        ok |= capped
        x, y = x[ok], y[ok]
        partners[x] += 1  # at one distance an entry is met once from either side
        partners[y] += 1
        open_ = (partners[x] <= crowd) | (partners[y] <= crowd)
        crowded[x[~open_]] = crowded[y[~open_]] = True
        out.append(np.stack([x[open_], y[open_]], axis=1))
    pairs = np.concatenate(out)
    of_two = (partners[pairs] > crowd).all(1)
    crowded[pairs[of_two].ravel()] = True
    digests = np.sort(entries["d"][pairs[~of_two]], axis=1)
    return np.unique(digests, axis=0) if len(digests) else digests, crowded


def _read(rows: pa.Table, name: str, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in rows[name].to_pylist() if x)])


def _meet(percent: int, hot: int, crowd: int):
    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, gone = _folded(_read(rows, "lines", LINE))
        earlier = _read(rows, "gone", PLACE)
        out = [_found(SET, first["d1"], first["d2"], first["doc"], first["line"], first["n"])]
        out += [_found(GONE, np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), g["doc"], g["line"]) for g in (gone, earlier)]
        narrow, wide = _read(rows, "narrow", NARROW), _read(rows, "wide", WIDE)
        entries = np.zeros(len(narrow) + len(wide), WIDE)
        for name in NARROW.names:
            entries[name] = np.concatenate([narrow[name], wide[name]])
        entries["c"][len(narrow) :] = wide["c"]
        is_wide = np.arange(len(entries)) >= len(narrow)
        # copies of a set from several tasks come to stand together, but for chance; those that don't are told by their digest
        order = np.argsort(entries["key"].astype(np.uint64) << np.uint64(32) | entries["n"].astype(np.uint64) << np.uint64(16) | entries["d"] & np.uint64(65535))
        entries, is_wide = entries[order], is_wide[order]
        new = np.append(True, (entries["key"][1:] != entries["key"][:-1]) | (entries["d"][1:] != entries["d"][:-1]))[: len(entries)]
        entries, is_wide = entries[new], is_wide[new]
        starts = np.flatnonzero(np.append(True, entries["key"][1:] != entries["key"][:-1])[: len(entries)])
        sizes = np.diff(np.append(starts, len(entries)))
        of = np.repeat(sizes, sizes)
        crowded, few = of > hot, np.flatnonzero((of > 1) & (of <= hot))
        pairs, with_many = pairs_within(entries[few], is_wide[few], percent, crowd)
        out.append(_found(PAIR, pairs[:, 0], pairs[:, 1]))
        crowded[few[with_many]] = True
        rows = entries[crowded]
        keys = np.uint64(key[0].as_py()) << np.uint64(32) | rows["key"].astype(np.uint64)
        out.append(_found(HOT, keys, rows["d"], rows["b"], rows["c"], rows["n"], rows["rest"]))
        del narrow, wide, entries, is_wide, order, first, gone, earlier, pairs, rows
        release()
        return pa.concat_tables(out)

    return meet


def _tokens(documents: np.ndarray, wanted: np.ndarray):
    def tokens(batches):
        reader = Lines()
        for r in each_text(batches):
            ids = np.array(r.column(0).to_pylist(), dtype=object)
            some = in_filter(documents, np.array([hashed(i) for i in ids], dtype=np.uint64))
            texts = [t for t, ok in zip(as_bytes(r.column(1)), some) if ok]
            for text, place, n, h, _, _ in reader.sets(texts) if texts else ():
                names = ids[some][text]
                keys = np.array([hashed(f"{i}:{j}".encode()) for i, j in zip(names, place.tolist())], dtype=np.uint64)
                hit, ends = np.flatnonzero(in_filter(wanted, keys)), np.cumsum(n)
                if len(hit):
                    digests = np.add.reduceat(mixed(h), ends - n)[hit].view(np.int64)
                    yield batch(TOKENS, {"doc_id": [names[i] for i in hit], "line": place[hit], "d1": digests, "tokens": [h[ends[i] - n[i] : ends[i]].tobytes() for i in hit]})

    return tokens


def _later(percent: int):
    """Of pairs of an earlier line and a later one, the later ones of those that match on whole word sets."""
    from .ngram_join import shared

    schema = pa.schema([("d1", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int64())])

    def later(batches):
        for r in each_text(batches, 1024):
            xs, ys = ([np.frombuffer(b, np.uint64) for b in r.column(c).to_pylist()] for c in ("xs", "ys"))
            both = np.array([shared(a, b) for a, b in zip(xs, ys)], dtype=np.int64)
            match = 100 * both >= percent * (np.array([len(a) + len(b) for a, b in zip(xs, ys)], dtype=np.int64) - both)
            yield pa.RecordBatch.from_arrays([r.column(c).filter(pa.array(match)) for c in schema.names], schema=schema)

    return later


def _matched(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(d1, doc_id, line) of the later lines of the pairs that match. pairs: d1, doc_id and line of the later line; x_d1, x_doc_id and x_line of the earlier one."""
    side = lambda p: tokens.select(*[F.col(c).alias(f"{p}_{c}") for c in PLACED], F.col("tokens").alias(f"{p}s"))
    both = pairs.select(*[F.col(f"x_{c}") for c in PLACED], *[F.col(c).alias(f"y_{c}") for c in PLACED])
    for p in ("x", "y"):
        both = both.join(side(p), [f"{p}_{c}" for c in PLACED])
    both = both.select("xs", "ys", *[F.col(f"y_{c}").alias(c) for c in PLACED])
    return both.mapInArrow(_later(percent), "d1 long, doc_id long, line long").distinct()


def _after(x: str, y: str) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(x, "doc_id") > c(y, "doc_id")) | ((c(x, "doc_id") == c(y, "doc_id")) & (c(x, "line") > c(y, "line")))


def _hot_pairs(left: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs of a line of `left` and an earlier one of `others` under one key that may match, by sizes, places and outlines."""
    x, y = left.alias("x"), others.alias("y")
    least, most = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    n = F.col("x.n") + F.col("y.n")
    b, c = F.col("x.b").bitwiseXOR(F.col("y.b")), F.col("x.c").bitwiseXOR(F.col("y.c"))
    bits = F.when(least > NARROW_WORDS, F.bit_count(c) + F.bit_count(b.bitwiseXOR(c))).otherwise(F.bit_count(b))
    near = (100 * least >= percent * most) & ((100 + percent) * F.least("x.rest", "y.rest") >= percent * n) & ((100 + percent) * bits <= (100 - percent) * n)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & _after("x", "y") & (near | (most == 65535)))
    return met.select(*[F.col(f"x.{c}") for c in PLACED], *[F.col(f"y.{c}").alias(f"x_{c}") for c in PLACED]).distinct()


def _hot_matched(rows: DataFrame, tokens: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(d1, doc_id, line) of crowded lines that match an earlier crowded line of a key of theirs. rows: key, d1, doc_id, line, b, c, n, rest.

    The earliest line of each key is held against the others, then the earliest of those that are left; what is left after that is
    joined with all lines of its keys.
    """
    left, pivots, gone = rows, None, None
    for _ in range(PIVOTS):
        fresh = left if pivots is None else left.join(pivots, ["key", *PLACED], "left_anti")
        first = fresh.groupBy("key").agg(F.min(F.struct("doc_id", "line", "d1", "b", "c", "n", "rest")).alias("p")).select("key", "p.*")
        first = scratch.written(first, "pivots")
        met = scratch.written(_matched(_hot_pairs(left, first, percent), tokens, percent), "met")
        gone = met if gone is None else gone.unionByName(met)
        pivots = first.select("key", *PLACED) if pivots is None else pivots.unionByName(first.select("key", *PLACED))
        left = scratch.written(left.join(met, list(PLACED), "left_anti").select(*rows.columns), "left")
    return scratch.written(gone.unionByName(_matched(_hot_pairs(left, rows, percent), tokens, percent)).distinct(), "hot_matched")


def _tokens_of(ends: DataFrame, source: DataFrame) -> DataFrame:
    """(d1, doc_id, line, tokens): whole word sets of the lines `ends`."""
    rows = ends.count()
    of_docs = build_filter(ends.select("doc_id").distinct(), F.xxhash64("doc_id"), filter_bits(rows))
    of_lines = build_filter(ends, F.xxhash64(F.concat_ws(":", "doc_id", "line")), filter_bits(rows))
    found = source.mapInArrow(_tokens(of_docs, of_lines), "doc_id long, line long, d1 long, tokens binary")
    return found.join(ends, list(PLACED)).select(*PLACED, "tokens")


def removed_lines(docs: DataFrame, *, percent: int = 80, cold: int = 1024, hot: int = 4096, crowd: int = 16) -> DataFrame:
    """(doc_id, removed): per document that loses lines, their places (from 0), sorted. docs: (doc_id, text)."""
    if not 0 < percent <= 100:
        raise ValueError("percent is a similarity from 1 to 100")
    spark = docs.sparkSession
    source = docs.where("doc_id is not null")
    with Scratch(spark) as scratch:
        levels, words = word_levels(source, scratch)
        blocks = max(int(words * (1.1 - percent / 100) // GROUP_KEYS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        tables = spark.sparkContext.broadcast(levels)
        dealt = source.mapInArrow(_deal(tables, percent, cold, blocks, words), "block long, lines binary, gone binary, narrow binary, wide binary")
        found = scratch.written(dealt.groupBy("block").applyInArrow(_meet(percent, hot, crowd), FOUND_COLUMNS), "found")
        tables.unpersist()
        del dealt
        swept(spark)
        sets = found.where(f"kind = {SET}").select(F.col("a").alias("d1"), F.col("c").alias("doc_id"), F.col("d").alias("line"))
        pairs = scratch.written(found.where(f"kind = {PAIR}").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "pairs")
        crowded = found.where(f"kind = {HOT}").select(*[F.col(c).alias(name) for c, name in zip("abcdef", ("key", "d1", "b", "c", "n", "rest"))])
        wanted = pairs.select(F.col("x").alias("d1")).unionByName(pairs.select(F.col("y").alias("d1"))).unionByName(crowded.select("d1")).distinct()
        ends = scratch.written(sets.join(wanted, "d1", "left_semi"), "ends")
        tokens = scratch.written(_tokens_of(ends, source), "tokens")
        end = lambda c: ends.select(F.col("d1").alias(c), F.struct("doc_id", "line", "d1").alias(f"{c}_end"))
        both = pairs.join(end("x"), "x").join(end("y"), "y").select(F.least("x_end", "y_end").alias("e"), F.greatest("x_end", "y_end").alias("l"))
        placed = both.select(*[F.col(f"l.{c}") for c in PLACED], *[F.col(f"e.{c}").alias(f"x_{c}") for c in PLACED])
        late = None
        if not crowded.isEmpty():
            crowded = scratch.written(crowded.join(ends, "d1"), "crowded")
            theirs = scratch.written(tokens.join(crowded.select(*PLACED).distinct(), list(PLACED), "left_semi"), "crowded_tokens")
            late = _hot_matched(crowded, theirs, percent, scratch)
            placed = placed.join(late, list(PLACED), "left_anti")
        matched = scratch.written(_matched(placed, tokens, percent), "matched")
        late = matched if late is None else matched.unionByName(late)
        lost = found.where(f"kind = {GONE}").select(F.col("c").alias("doc_id"), F.col("d").alias("line")).unionByName(late.select("doc_id", "line")).distinct()
        repeated = scratch.written(source.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
        if not repeated.isEmpty():  # a place may then have several texts
            stays = sets.join(repeated, "doc_id", "left_semi").join(late, list(PLACED), "left_anti").select("doc_id", "line")
            lost = lost.join(stays, ["doc_id", "line"], "left_anti")
        return written(lost.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed")), "removed")


def _by_filter(id_at: int, text_at: int, words: np.ndarray, inside: bool):
    """Rows, and their number of lines, whose id may be in the filter, or the others; a row with a null id is none of the former."""

    def rows(batches):
        for r in each_text(batches, 4096):
            ids = r.column(id_at).to_pylist()
            may = in_filter(words, np.array([0 if i is None else hashed(int(i)) for i in ids], dtype=np.uint64)) & np.array([i is not None for i in ids], dtype=bool)
            some = r.filter(pa.array(may == inside))
            ends = pc.fill_null(pc.add(pc.count_substring(some.column(text_at), "\n").cast(pa.int64()), 1), 0)
            yield pa.RecordBatch.from_arrays([*some.columns, ends], names=[*some.schema.names, "n_lines"])

    return rows


def without(text: str | None, places: list[int] | None) -> str | None:
    """`text` less its lines at `places`."""
    if text is None or not places:
        return text
    gone = set(places)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _cut(text_at: int, removed_at: int):
    def cut(batches):
        for r in each_text(batches):
            texts = [without(t, p) for t, p in zip(r.column(text_at).to_pylist(), r.column(removed_at).to_pylist())]
            yield r.set_column(text_at, r.schema.field(text_at), pa.array(texts, type=r.schema.field(text_at).type))

    return cut


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The columns of `docs` with the text less its removed lines, plus n_lines, n_removed and removed (places from 0), one row for each row of `docs`."""
    docs = docs.drop("n_lines", "n_removed", "removed")
    removed = removed_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), **rules)
    id_name, none = free_name(docs.columns, "removed_of"), F.lit(None).cast("array<bigint>")
    removed = removed.select(F.col("doc_id").alias(id_name), "removed")
    words = build_filter(removed, F.xxhash64(id_name), filter_bits(removed.count()))
    of, counted = (docs.columns.index(id_col), docs.columns.index(text_col)), StructType([*docs.schema, StructField("n_lines", LongType())])
    same = docs.mapInArrow(_by_filter(*of, words, False), counted).withColumn("removed", none)
    # only documents that may lose a line are shuffled; at any size, so that a run on little data tells what one on much will do
    touched = docs.mapInArrow(_by_filter(*of, words, True), counted)
    joined = touched.join(removed.hint("merge"), touched[id_col].cast("long") == removed[id_name], "left").drop(id_name)
    joined = joined.withColumn("removed", F.when(F.col(text_col).isNotNull(), F.col("removed")))
    cut = joined.mapInArrow(_cut(joined.columns.index(text_col), joined.columns.index("removed")), joined.schema)
    out = same.unionByName(cut).withColumn("n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long"))
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text")


SQL = """
with lines as (select doc_id, i - 1 as line, list_distinct(list_filter(string_split_regex(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as w
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
sets as (select doc_id, line, len(w) as n, list_sort(w) as w from lines where len(w) >= 1),
folded as (select min((doc_id, line)) as first, w, any_value(n) as n from sets group by w),
counts as (select t, count(*) as c from (select unnest(w) as t from folded) group by t),
ranked as (select first, n, t, row_number() over (partition by first order by c, t) as pos from (select first, n, unnest(w) as t from folded) join counts using (t)),
prefixes as (select * from ranked where pos <= n - ceil(n * 0.8) + 1),
candidates as (select distinct a.first as a, b.first as b from prefixes a join prefixes b on a.t = b.t and a.first < b.first and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
matched as (select distinct c.b as first from candidates c join folded x on x.first = c.a join folded y on y.first = c.b
  where 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone as (select s.doc_id, s.line from sets s join folded f on s.w = f.w where (s.doc_id, s.line) <> f.first or f.first in (select first from matched)),
removed as (select doc_id, list(line order by line) as removed from gone group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(len(removed), 0) as bigint) as n_removed, coalesce(array_to_string(removed, ','), '') as removed,
  case when removed is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(removed, i - 1)), chr(10)) end as text
from documents d left join removed using (doc_id)
"""
