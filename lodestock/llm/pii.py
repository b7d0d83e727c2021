"""Personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Base kinds are found by rule and always reported: email, ip, card, phone. The model tags each character with the start or the
inside of a kind, or with neither. It learns from windows of invented carrier text, or of a bounded sample of documents, into
which spans of many written forms are put at known places, beside numbers that are none. Every kind has a digit or an at-sign,
so only the text around these is decoded, in overlapping windows; where windows disagree, the one holds in whose middle a
character lies nearest. A found span is added if it passes its kind's check and touches no base span.

Nulls: a null text is empty and has no span; ids are passed on. Repeated rows give repeated results, an empty table an empty
one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, each_text, table, texts_of

KINDS = ("email", "ip", "card", "phone")
#: O, then the start and the inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost, non-overlapping within a kind, matches that fail their check dropped."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# -- the model ---------------------------------------------------------------------------------------------------------


def symbols(text: str) -> np.ndarray:
    """A character's row in the embedding: lower, upper, digit, space, line end, other signs of ASCII each, the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return SYMBOL[np.minimum(points, 128)]


SYMBOL = np.arange(129)
SYMBOL[128] = 1
for _first, _last, _to in ((97, 122, 2), (65, 90, 3), (48, 57, 4), (9, 13, 5), (32, 32, 6)):
    SYMBOL[_first : _last + 1] = _to
N_SYMBOLS = 129


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name: emb, and for each direction wx, wh, b; out, out_b; trans (from, to), first, last."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(embedding: int = 10, hidden: int = 16, seed: int = 5, dtype=np.float32) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"emb": rng.normal(0, 0.3, (N_SYMBOLS, embedding)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "out_b": np.zeros(TAGS), "trans": rng.normal(0, 0.1, (TAGS, TAGS)), "first": np.zeros(TAGS), "last": np.zeros(TAGS)}
        for d in "fb":
            p |= {f"wx{d}": rng.normal(0, embedding**-0.5, (embedding, 4 * hidden)), f"wh{d}": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        return Tagger({k: v.astype(dtype) for k, v in p.items()})

    def _run(self, x, d):
        """Gates, cells and outputs of one direction; x: (n, t, e)."""
        wh = self.p["wh" + d]
        h = wh.shape[0]
        n, t, _ = x.shape
        pre = x @ self.p["wx" + d] + self.p["b" + d]
        gates, cells, outs = np.empty((t, n, 4 * h), x.dtype), np.empty((t, n, h), x.dtype), np.empty((t, n, h), x.dtype)
        out = cell = np.zeros((n, h), x.dtype)
        for i in range(t):
            z = pre[:, i] + out @ wh
            g = gates[i]
            g[:, : 3 * h] = sigmoid(z[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            out = g[:, 2 * h : 3 * h] * np.tanh(cell)
            cells[i], outs[i] = cell, out
        return gates, cells, outs

    def _back(self, x, d, state, d_outs, grads):
        gates, cells, outs = state
        wh = self.p["wh" + d]
        h, (n, t, _) = wh.shape[0], x.shape
        d_pre = np.empty((n, t, 4 * h), x.dtype)
        d_out = d_cell = np.zeros((n, h), x.dtype)
        for i in range(t - 1, -1, -1):
            g, c = gates[i], np.tanh(cells[i])
            i_, f_, o_, u_ = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            d_o = d_outs[i] + d_out
            d_c = d_cell + d_o * o_ * (1 - c * c)
            before = cells[i - 1] if i else np.zeros_like(d_c)
            d_pre[:, i] = np.concatenate([d_c * u_ * i_ * (1 - i_), d_c * before * f_ * (1 - f_), d_o * c * o_ * (1 - o_), d_c * i_ * (1 - u_ * u_)], 1)
            d_cell = d_c * f_
            d_out = d_pre[:, i] @ wh.T
            if i:
                grads["wh" + d] += outs[i - 1].T @ d_pre[:, i]
        grads["wx" + d] += np.einsum("nte,ntg->eg", x, d_pre, optimize=True)
        grads["b" + d] += d_pre.sum((0, 1))
        return d_pre @ self.p["wx" + d].T

    def emissions(self, at):
        x = self.p["emb"][at]
        fwd, bwd = self._run(x, "f"), self._run(x[:, ::-1], "b")
        both = np.concatenate([fwd[2], bwd[2][::-1]], 2)  # (t, n, 2h)
        return both @ self.p["out"] + self.p["out_b"], (x, fwd, bwd, both)

    def loss(self, at, tags, grads=None):
        """Mean negative log-likelihood of the tag sequences; adds its gradient to `grads`."""
        e, (x, fwd, bwd, both) = self.emissions(at)
        t, n, k = e.shape
        trans, rows = self.p["trans"], np.arange(n)
        alpha = np.empty_like(e)
        alpha[0] = self.p["first"] + e[0]
        for i in range(1, t):
            alpha[i] = log_sum(alpha[i - 1][:, :, None] + trans, 1) + e[i]
        z = log_sum(alpha[-1] + self.p["last"], 1)
        gold = self.p["first"][tags[:, 0]] + self.p["last"][tags[:, -1]] + e[np.arange(t)[:, None], rows, tags.T].sum(0) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        if grads is None:
            return float((z - gold).mean())
        beta = np.empty_like(e)
        beta[-1] = self.p["last"]
        d_trans = np.zeros_like(trans)
        for i in range(t - 2, -1, -1):
            to = e[i + 1] + beta[i + 1]
            pair = alpha[i][:, :, None] + trans + to[:, None, :]
            beta[i] = log_sum(trans + to[:, None, :], 2)
            d_trans += np.exp(pair - z[:, None, None]).sum(0)
        d_e = np.exp(alpha + beta - z[:, None])
        grads["first"] += (d_e[0].sum(0) - np.bincount(tags[:, 0], minlength=k)) / n
        grads["last"] += (d_e[-1].sum(0) - np.bincount(tags[:, -1], minlength=k)) / n
        np.add.at(d_trans, (tags[:, :-1], tags[:, 1:]), -1)
        grads["trans"] += d_trans / n
        d_e[np.arange(t)[:, None], rows, tags.T] -= 1
        d_e /= n
        grads["out"] += np.einsum("tnh,tnk->hk", both, d_e, optimize=True)
        grads["out_b"] += d_e.sum((0, 1))
        d_both = d_e @ self.p["out"].T
        h = d_both.shape[2] // 2
        d_x = self._back(x, "f", fwd, d_both[:, :, :h], grads)
        d_x = d_x + self._back(x[:, ::-1], "b", bwd, d_both[::-1, :, h:], grads)[:, ::-1]
        np.add.at(grads["emb"], at, d_x)
        return float((z - gold).mean())

    def decode(self, at):
        """Best tag sequences, (n, t)."""
        e, _ = self.emissions(at)
        t, n, k = e.shape
        score, back = self.p["first"] + e[0], np.empty((t, n, k), np.int8)
        for i in range(1, t):
            step = score[:, :, None] + self.p["trans"]
            back[i] = step.argmax(1)
            score = step.max(1) + e[i]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = (score + self.p["last"]).argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[i][np.arange(n), tags[:, i]]
        return tags


# -- labelled spans ----------------------------------------------------------------------------------------------------


class Writer:
    """Invents carriers, spans of every kind in many written forms, and numbers that are none."""

    def __init__(self, seed: int, carriers: list[str]):
        self.rng = np.random.default_rng(seed)
        self.carriers = [c for c in carriers if len(c) > 20]

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def number(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        return "".join(self.pick("bcdfghlmnprstvw") + self.pick("aeiou") for _ in range(int(self.rng.integers(1, 5))))

    def carrier(self, n: int) -> str:
        if self.carriers and self.rng.random() < 0.7:
            text = self.pick(self.carriers)
            at = int(self.rng.integers(max(1, len(text) - n)))
            return TRIGGER.sub("", text[at : at + n])
        out = ""
        while len(out) < n:
            out += self.word() + self.pick((" ", " ", " ", ", ", ". ", "\n"))
        return out[:n]

    def span(self, kind: str) -> str:
        n, w = self.number, self.word
        if kind == "email":
            local = self.pick((w() + n(2), f"{w()}.{w()}", f"{w()}_{n(1)}", f"{w()}.{n(2)}", w().title()))
            return f"{local}{self.pick(('@', '@', '@', ' @ ', '[@]'))}{self.pick((w(), 'mail' + n(1)))}.{self.pick(('com', 'org', 'net', 'example.com', 'de', 'co.uk'))}"
        if kind == "ip":
            parts = [str(int(x)) for x in self.rng.integers(0, 256, 4)]
            return self.pick((".", ".", "[.]", " . ")).join(parts)
        if kind == "card":
            d = str(int(self.rng.integers(3, 7))) + n(14)
            d += next(c for c in "0123456789" if luhn(d + c))
            return self.pick(("", " ", "-", ".")).join(d[i : i + 4] for i in range(0, 16, 4))
        a, b, c = n(3), n(3), n(4)
        return self.pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{n(2)} {n(2)} {c} {n(4)}", f"+{n(2)}-{n(2)}-{n(7)}", f"00{n(2)} {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+{n(11)}", f"1-{a}-{b}-{c}"))

    def other(self) -> str:
        n = self.number
        return self.pick((n(4), f"{n(1)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(1)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"{n(2)}/0{n(1)}/20{n(2)}", f"${n(2)}.{n(2)}", f"{n(1)} {n(1)} {n(1)}", f"{n(2)}:{n(2)}", hashlib.sha1(n(9).encode()).hexdigest(), f'token = "{hashlib.md5(n(9).encode()).hexdigest()}"', "AKIA" + n(3) + self.word().upper() + n(5), n(8), n(12), f"{n(2)}%", "@" + self.word(), f"version {n(1)}.0", f"CC BY-NC {n(1)}.0"))

    def example(self, size: int = WINDOW) -> tuple[str, np.ndarray]:
        text, tags = "", []
        for _ in range(int(self.rng.integers(1, 4))):
            text += self.carrier(int(self.rng.integers(5, 60))).rstrip() + " "
            tags += [0] * (len(text) - len(tags))
            if self.rng.random() < 0.6:
                kind = int(self.rng.integers(len(KINDS)))
                s = self.span(KINDS[kind])
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = self.other()
                tags += [0] * len(s)
            text += s + self.pick((" ", " ", ", ", ". ", "\n", "### "))
            tags += [0] * (len(text) - len(tags))
        at = int(self.rng.integers(max(1, len(text) - size + 1))) if len(text) > size else 0
        text = text[at : at + size]
        return text.ljust(size), np.array((tags[at : at + size] + [0] * size)[:size])


def train(carriers: list[str], *, examples: int = 6000, epochs: int = 5, size: int = 64, rate: float = 0.01, seed: int = 5) -> Tagger:
    writer, model = Writer(seed, carriers), Tagger.new(seed=seed)
    made = [writer.example() for _ in range(examples)]
    at, tags = np.stack([symbols(t) for t, _ in made]), np.stack([y for _, y in made])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, steps = 0, epochs * -(-examples // size)
    for _ in range(epochs):
        order = writer.rng.permutation(examples)
        for a in range(0, examples, size):
            grads = {k: np.zeros_like(v) for k, v in model.p.items()}
            model.loss(at[order[a : a + size]], tags[order[a : a + size]], grads)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g *= min(1.0, 5 / (norm + 1e-9))
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[k] -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


# -- decoding whole texts ----------------------------------------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, wide enough for context; apart from each other."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[int]:
    """Starts of the overlapping windows over a stretch; the last one may reach beyond it."""
    return list(range(a, max(a + 1, b - WINDOW + STRIDE), STRIDE))


def reconciled(tags: dict[int, np.ndarray], a: int, b: int) -> np.ndarray:
    """One tag a character of [a, b): from the window whose middle is nearest."""
    out, near = np.zeros(b - a, np.int8), np.full(b - a, WINDOW)
    for start, found in tags.items():
        end = min(start + WINDOW, b)
        off = np.abs(2 * np.arange(end - start) - WINDOW + 1) // 2
        better = off < near[start - a : end - a]
        out[start - a : end - a][better] = found[: end - start][better]
        near[start - a : end - a][better] = off[better]
    return out


def spans_in(tags: np.ndarray, a: int) -> list[tuple[str, int, int]]:
    """Runs of one kind; a start tag begins a new one."""
    kinds = (tags + 1) // 2
    edges = np.flatnonzero((np.diff(kinds, prepend=0, append=0) != 0) | (np.append((tags % 2 == 1) & (tags > 0), False)))
    return [(KINDS[kinds[i] - 1], a + i, a + j) for i, j in zip(edges, edges[1:]) if kinds[i]]


def checked(kind: str, found: str) -> bool:
    d = digits_of(found)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s?\[?@\]?\s?[\w-]+(?:\.[\w-]+)+", found))
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9]+(?:\s?\[?\.\]?\s?[0-9]+){3}", found))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9](?:[\s.-]?[0-9])+", found))
    groups = re.findall("[0-9]+", found)
    return 9 <= len(d) <= 15 and (len(groups) > 1 or found[0] == "+") and bool(re.fullmatch(r"\+?\(?[0-9][0-9\s().-]*[0-9]", found))


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones, all windows of all texts decoded together."""
    stretches = [regions(t) for t in texts]
    places = [(i, a, b, s) for i, of in enumerate(stretches) for a, b in of for s in windows(a, b)]
    decoded: dict[tuple[int, int, int], dict[int, np.ndarray]] = {}
    for k in range(0, len(places), 4096):
        part = places[k : k + 4096]
        tags = model.decode(np.stack([symbols(texts[i][s : min(s + WINDOW, b)].ljust(WINDOW)) for i, _, b, s in part]))
        for (i, a, b, s), found in zip(part, tags):
            decoded.setdefault((i, a, b), {})[s] = found
    out = []
    for i, text in enumerate(texts):
        base = base_spans(text) if stretches[i] else []
        taken = sorted((s, e) for _, s, e in base)
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
        added = []
        for a, b in stretches[i]:
            for kind, s, e in spans_in(reconciled(decoded[i, a, b], a, b), a):
                while e > s and text[e - 1].isspace():
                    e -= 1
                k = int(np.searchsorted(starts, e)) if taken else 0  # base spans that begin before e
                if (k == 0 or reach[k - 1] <= s) and e > s and checked(kind, text[s:e]):
                    added.append((kind, s, e))
        out.append((base, added))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def _scan(parameters: dict[str, np.ndarray]):
    def scan(batches):
        model = Tagger(parameters)
        for r in each_text(batches):
            found = all_spans(texts_of(r.column(1)), model)
            yield batch(OUT, {
                "doc_id": r.column(0), **{f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}, "n_added": [len(more) for _, more in found],
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], "spans": [joined(base + more) for base, more in found],
            })

    return scan


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None, carriers: int = 200) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans), one row for each row of `docs`.

    Without a model one is trained, its carrier text taken from at most `carriers` documents in the order of a hash of their ids.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        chosen = source.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(carriers)
        some = source.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending")])
        model = train(texts_of(some["text"]))
    return source.mapInArrow(_scan(model.p), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents"))
