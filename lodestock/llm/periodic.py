"""Periodic run detection: every maximal stretch of words that repeats with a period, by heavy and light lag counting.

For each lag q the pairs of equal words q apart are counted first: words that are frequent in their document by one exact FFT
autocorrelation of their indicator rows, rare ones by the differences of their places. A run of period q makes at least
max(q, 12 - q) consecutive pairs, so only lags with as many pairs get an island scan. Lags are taken in ascending order. A run of
period p explains its pairs at the multiples of p; two runs share less than the sum of their periods, so the explained pairs of a lag
are no part of a new run there and are taken off its count: a text of one word costs one scan, not n / 2.

Documents are dealt with in blocks of some hundred thousand words whose numbers never agree between documents, so that one pass
serves many short ones; a long one is a block of its own. Its scans look at every need-th word only, as an island of `need` pairs
holds one of these, and go on only where half an island matches: n log n steps in all for words drawn at random.

Words are parted by space and U+0009 to U+000D. Nulls: a null text has no words and so no runs; a null id is a row like any other
(and in the query gets no planted tail). Repeated rows give repeated results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, each_text, table

#: Least length of a run in words, and words dealt with together.
LEAST, BLOCK = 12, 1 << 17
#: Words of more occurrences than this, and than the root of their document's length, are frequent.
LIGHT = 64
#: Documents up to this many words, and lags up to this one, are scanned word by word.
SHORT, CLOSE = 1 << 13, 16
OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])
Plant = Callable[[int | None, list[bytes]], list[bytes]]


def need(q):
    """Least pairs of a run of period q."""
    return np.maximum(q, LEAST - q)


def pairs(ids: np.ndarray, bounds: np.ndarray, base: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Pairs of equal words by document and lag, at base[document] + lag. ids: word numbers, no two documents share one."""
    size = np.diff(bounds)
    count = np.zeros(int(base[-1]), np.int64)
    at = np.argsort(ids, kind="stable")
    word = ids[at]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    times = np.diff(first, append=len(word))
    doc = np.searchsorted(bounds, at[first], "right") - 1
    frequent = times > np.maximum(LIGHT, np.sqrt(size[doc]).astype(np.int64))
    # rare words: each place with the next one, the one after that, and so on
    alive = np.flatnonzero(np.repeat(~frequent, times))
    most, of = np.repeat(half[doc], times), np.repeat(base[doc[: len(first)]], times)
    waiting, waits, step = [], 0, 1
    while len(alive):
        alive = alive[alive + step < len(word)]
        alive = alive[word[alive + step] == word[alive]]
        lag = at[alive + step] - at[alive]
        near = lag <= most[alive]
        alive = alive[near]
        waiting.append(of[alive] + lag[near])
        waits += len(alive)
        step += 1
        if waits > len(count) + BLOCK or not len(alive):
            count += np.bincount(np.concatenate(waiting), minlength=len(count))
            waiting, waits = [], 0
    # frequent ones: the power spectra of their indicators, summed, are the spectrum of the count
    for d in np.unique(doc[frequent]):
        n, h = int(size[d]), int(half[d])
        wide = 1 << (n + h).bit_length()
        power = np.zeros(wide // 2 + 1)
        for g in np.flatnonzero(frequent & (doc == d)):
            row = np.zeros(wide)
            row[at[first[g] : first[g] + times[g]] - bounds[d]] = 1
            spectrum = np.fft.rfft(row)
            power += spectrum.real**2 + spectrum.imag**2
        count[base[d] + 1 : base[d] + h + 1] += np.rint(np.fft.irfft(power, wide)[1 : h + 1]).astype(np.int64)
    return count


def _every(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    hit = np.flatnonzero(ids[:-q] == ids[q:])
    if len(hit) < least:
        return []
    cut = np.flatnonzero(np.diff(hit) != 1) + 1
    a = hit[np.concatenate([[0], cut])]
    length = np.diff(np.concatenate([[0], cut, [len(hit)]]))
    some = length >= least
    return list(zip(a[some].tolist(), length[some].tolist()))


def _reach(ids: np.ndarray, at: int, q: int, way: int) -> int:
    """How many pairs from `at` on match, forwards (way 1) or backwards (-1), `at` included."""
    got, step = 0, 64
    while True:
        a = at + way * got
        left = len(ids) - q - a if way > 0 else a + 1
        step = min(step, left)
        if step <= 0:
            return got
        same = ids[a : a + step] == ids[a + q : a + q + step] if way > 0 else (ids[a - step + 1 : a + 1] == ids[a - step + 1 + q : a + 1 + q])[::-1]
        if not same.all():
            return got + int(same.argmin())
        got, step = got + step, step * 2


def _half_way(ids: np.ndarray, at: np.ndarray, q: int, far: int, way: int) -> np.ndarray:
    """Those of `at` from which the next `far` pairs match."""
    got, step = 1, 8
    while got <= far and len(at):
        step = min(step, far - got + 1)
        at = at[(at + far < len(ids) - q) if way > 0 else (at - far >= 0)] if got == 1 else at
        to = at[:, None] + way * np.arange(got, got + step)
        at = at[(ids[to] == ids[to + q]).all(1)]
        got += step
        step = min(step * 2, max(8, (1 << 20) // max(len(at), 1)))
    return at


def islands(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(first, pairs) of every maximal stretch of at least need(q) pairs of equal words q apart."""
    least = int(need(q))
    if len(ids) <= q:
        return []
    if len(ids) <= SHORT or q <= CLOSE:
        return _every(ids, q, least)
    at = np.arange(0, len(ids) - q, least)
    at = at[ids[at] == ids[at + q]]
    far = (least - 1) // 2
    out, end = [], -1
    for a in np.union1d(_half_way(ids, at, q, far, 1), _half_way(ids, at, q, far, -1)).tolist():
        if a < end:
            continue
        back, on = _reach(ids, a, q, -1), _reach(ids, a, q, 1)
        end = a + on
        if back + on - 1 >= least:
            out.append((a - back + 1, back + on - 1))
    return out


def runs(ids: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period."""
    size = np.diff(bounds)
    half = size // 2
    base = np.concatenate([[0], np.cumsum(half + 1)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in size]
    if not len(ids):
        return out
    count = pairs(ids, bounds, base, half)
    lag = np.arange(len(count)) - np.repeat(base[:-1], half + 1)
    some = np.flatnonzero((lag > 0) & (count >= need(lag)))
    some = some[np.argsort(lag[some], kind="stable")]
    lags, first = np.unique(lag[some], return_index=True)
    seen = set()
    for q, at in zip(lags.tolist(), np.split(some, first[1:])):
        at = at[count[at] >= need(q)]
        if not len(at):
            continue
        docs = np.searchsorted(base, at, "right") - 1
        if 4 * size[docs].sum() > len(ids) and len(size) > 1:
            found = _every(ids, q, int(need(q)))
        else:
            found = [(int(bounds[d]) + a, n) for d in docs.tolist() for a, n in islands(ids[bounds[d] : bounds[d + 1]], q)]
        for a, n in found:
            length = n + q
            if (a, length) in seen:  # a divisor of q is its period
                continue
            seen.add((a, length))
            d = int(np.searchsorted(bounds, a, "right")) - 1
            out[d].append((a - int(bounds[d]), length, q))
            more = np.arange(2 * q, min(length, int(half[d]) + 1), q)
            count[base[d] + more] -= length - more
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's known repetition: of every tenth document by the CRC-32 of its id, the end is made to repeat."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


def _blocks(rows, plant: Plant | None):
    """Documents' ids and words, some hundred thousand words at a time."""
    keys, texts, total = [], [], 0
    for r in each_text(rows, 64):
        for key, text in zip(r.column(0).to_pylist(), as_bytes(r.column(1))):
            words = text.split()
            if plant:
                words = plant(key, words)
            if total + len(words) > BLOCK and keys:
                yield keys, texts
                keys, texts, total = [], [], 0
            keys.append(key)
            texts.append(words)
            total += len(words)
    if keys:
        yield keys, texts


def _detect(plant: Plant | None):
    def detect(rows):
        for keys, texts in _blocks(rows, plant):
            ids, known = [], 0
            for words in texts:
                number: dict[bytes, int] = {}
                ids.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) + known)
                known += len(number)
            bounds = np.cumsum([0] + [len(x) for x in ids])
            found = runs(np.concatenate(ids), bounds)
            best = [min(f, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None)) for f in found]
            yield batch(OUT, {
                "doc_id": keys, "n_words": [len(w) for w in texts], "n_runs": [len(f) for f in found],
                "start": [b[0] for b in best], "length": [b[1] for b in best], "period": [b[2] for b in best], "exponent_milli": [b[1] and 1000 * b[1] // b[2] for b in best],
                "runs_sha256": [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in f).encode()).hexdigest() for f in found],
                "collapsed_sha256": [hashlib.sha256(b" ".join(collapsed(w, f))).hexdigest() for w, f in zip(texts, found)],
            })

    return detect


def _collapse(rows):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_runs", pa.int64())])
    for keys, texts in _blocks(rows, None):
        for key, words in zip(keys, texts):
            number: dict[bytes, int] = {}
            (found,) = runs(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64), np.array([0, len(words)]))
            yield batch(schema, {"doc_id": [key], "text": [b" ".join(collapsed(words, found)).decode()], "n_runs": [len(found)]})


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: Plant | None = None) -> DataFrame:
    """(doc_id, n_words, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256), one row for each row of `docs`.

    plant: changes a document's words first, for tests on known repetitions.
    """
    return _source(docs, id_col, text_col).mapInArrow(_detect(plant), "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_runs): each text with every run cut to its first period, words joined by one space."""
    return _source(docs, id_col, text_col).mapInArrow(_collapse, "doc_id long, text string, n_runs long")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=planted_tail)
