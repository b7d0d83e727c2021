"""Hashes of all words of many texts at once, in numpy: a polynomial over the bytes, read off one running sum."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time, so few that their numbers stay in a core's cache; a longer text is taken in pieces cut at white space.
PIECE = 1 << 18
SPACES = b" \t\n\x0b\x0c\r"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    def __init__(self, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, (1 << 64) - 1, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.powers = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    @staticmethod
    def _powers(base: int, size: int = PIECE + 1) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.space[data], [True]])))
        starts, ends = edge[::2], edge[1::2]
        if len(data) > PIECE:  # one word longer than a piece
            return np.array([self._long(data[s:e]) for s, e in zip(starts, ends)], dtype=np.uint64), starts, ends
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.powers[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.inverse[starts]), starts, ends

    def _long(self, word: np.ndarray) -> int:
        h, shift = 0, 1
        for a in range(0, len(word), PIECE):
            part = word[a : a + PIECE]
            h += int((self.byte[part] * self.powers[: len(part)]).sum(dtype=np.uint64)) * shift
            shift = shift * int(self.powers[PIECE]) & (1 << 64) - 1
        return int(mixed(np.array([h & (1 << 64) - 1], dtype=np.uint64))[0])

    def split(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every word; words are parted by space and U+0009 to U+000D."""
        data = np.frombuffer(text, np.uint8)
        out = []
        a = 0
        while a < len(data) or not out:
            b = min(len(data), a + PIECE)
            if b < len(data):
                cut = np.flatnonzero(self.space[data[a:b]])
                if len(cut):
                    b = a + int(cut[-1]) + 1
                else:  # no white space in a whole piece: up to the next one
                    later = np.flatnonzero(self.space[data[b:]])
                    b += int(later[0]) + 1 if len(later) else len(data) - b
            h, s, e = self._piece(data[a:b])
            out.append((h, s + a, e + a))
            a = b
        return tuple(np.concatenate(x) for x in zip(*out)) if len(out) > 1 else out[0]


def grouped(texts: list[bytes], size: int = 1 << 17):
    """Runs (first, last) of texts of about `size` bytes together."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
