"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (4 and 5, with word ends) and of itself, all hashed into
one table; a text's vector is the mean over its distinct words, and a softmax over two labels reads it. Table and softmax are
trained together by stochastic gradient steps with a rate of its own for each row of the table, so that rare n-grams move
fast. A misspelling never seen shares most n-grams with the word it stands for. As the softmax is linear, a word contributes one number;
scoring looks these up and never holds vectors.

Learns from at most `most_labelled` labelled rows, in the order of a hash of their ids. Labels, language, source and id are no
inputs. Nulls: a null or empty text has no words and gets the score of the bias alone; rows with a null id or label are not
learnt from; of labels that contradict each other the smaller counts, and of several texts of one labelled id the one whose words
come first; without labelled rows every score is 0.5. Repeated rows get repeated scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from math import fsum
from zlib import crc32
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, each_text, table, texts_of

WORD = re.compile(r"[^\W_]+(?:[@$*!0-9][^\W_]+)*")
#: Signs that stand for letters inside words.
RUN = re.compile(r"(.)\1{2,}")
STANDS_FOR = str.maketrans("@$013457!", "asoieastI".lower())
BUCKETS, DIM = 1 << 18, 4
MASK = BUCKETS - 1
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
#: Words whose numbers a task remembers before it starts anew.
MOST_REMEMBERED = 400_000


def words_of(text: str) -> set[str]:
    """Distinct words of a whole text in lower case."""
    return set(WORD.findall(text.lower()))


def grams(word: str) -> list[int]:
    """Rows of the table: the word itself and its n-grams of 4 and 5 characters, ends marked; signs inside words are read as letters, and runs of a letter as two."""
    if not word.isalpha():
        word = word if word.isdigit() else word.translate(STANDS_FOR)
    if RUN.search(word):
        word = RUN.sub(r"\1\1", word)
    w = f"<{word}>"
    n = len(w)
    parts = {w[i : i + 4] for i in range(n - 3)}
    parts.update([w[i : i + 5] for i in range(n - 4)])
    parts.add(w)
    return [crc32(p.encode()) & MASK for p in parts]


@dataclass
class Model:
    """`weight`: what each row of the table adds to the difference of the two labels' logits; `bias`: the rest of it."""

    weight: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.rows = self.weight.tolist()

    def word(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_REMEMBERED:
                self.known.clear()
            at = grams(word)
            found = self.known[word] = fsum([self.rows[i] for i in at]) / len(at)
        return found

    def score(self, text: str) -> float:
        words = words_of(text)
        z = self.bias + (fsum([self.word(w) for w in words]) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], toxic: np.ndarray, **steps) -> Model:
    return train_words([sorted(words_of(t)) for t in texts], toxic, **steps)


def train_words(bags_of_words: list[list[str]], toxic: np.ndarray, *, epochs: int = 8, rate: float = 1.0, size: int = 32, weight: float = 2.0, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    rows: dict[str, np.ndarray] = {}
    vocabulary: dict[str, int] = {}
    bags = []
    for words in bags_of_words:
        for w in words:
            if w not in rows:
                rows[w] = np.array(sorted(grams(w)))
                vocabulary[w] = len(vocabulary)
        bags.append(np.array([vocabulary[w] for w in words], dtype=np.int64))
    if not bags or not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros(BUCKETS), 0.0 if not len(toxic) else float(np.clip(np.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3)), -6, 6)))
    lists = list(rows.values())
    sizes = np.array([len(x) for x in lists])
    starts, flat = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(lists) if lists else np.zeros(0, np.int64)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), size):
            docs = order[a : a + size]
            words = np.concatenate([bags[d] for d in docs])
            if not len(words):
                continue
            of_doc = np.repeat(np.arange(len(docs)), [len(bags[d]) for d in docs])
            per_word = sizes[words]
            at = flat[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(per_word)[:-1]]), per_word) + np.arange(per_word.sum())]
            share = np.repeat(1 / per_word / np.maximum(np.array([len(bags[d]) for d in docs]), 1)[of_doc], per_word).astype(np.float32)
            gram_doc = np.repeat(of_doc, per_word)
            hidden = np.stack([np.bincount(gram_doc, emb[at, k] * share, len(docs)) for k in range(DIM)], 1).astype(np.float32)
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), toxic[docs].astype(int)] -= 1
            p *= np.where(toxic[docs], weight, 1.0)[:, None].astype(np.float32) / len(docs)
            d_hidden = p @ soft.T
            rows_at, inverse = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(inverse, d_hidden[gram_doc, k] * share, len(rows_at)) for k in range(DIM)], 1).astype(np.float32)
            g_emb[rows_at] += (grad**2).mean(1)
            emb[rows_at] -= rate * grad / np.sqrt(g_emb[rows_at])[:, None]
            d_soft, d_bias = hidden.T @ p, p.sum(0)
            g_soft += d_soft**2
            g_bias += d_bias**2
            soft -= 0.1 * rate * d_soft / np.sqrt(g_soft)
            bias -= 0.1 * rate * d_bias / np.sqrt(g_bias)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _words(batches):
    """The distinct words of each text, in order."""
    for r in each_text(batches):
        words = pa.array([sorted(words_of(t)) for t in texts_of(r.column(1))], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([r.column(0), r.column(2), words], names=["doc_id", "toxic", "words"])


def fitted(docs: DataFrame, labels: DataFrame, most_labelled: int) -> Model:
    """The model learnt from labelled rows: docs (doc_id, text), labels (doc_id, toxic). The driver gets their distinct words, one row an id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    found = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").mapInArrow(_words, "doc_id long, toxic int, words array<string>")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("words").alias("words")).toArrow().sort_by([("doc_id", "ascending")])
    return train_words(rows["words"].to_pylist(), rows["toxic"].to_numpy() == 1)


def _score(weight: np.ndarray, bias: float):
    def score(batches):
        model = Model(weight, bias)
        for r in each_text(batches):
            scores = [model.score(t) for t in texts_of(r.column(1))]
            yield batch(OUT, {"doc_id": r.column(0), "score": scores, "predicted": [int(s >= 0.5) for s in scores]})

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 6000) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of `docs`. `labels`: (doc_id, toxic 0 or 1), already without any held-out rows."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fitted(source, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")), most_labelled)
    return source.mapInArrow(_score(model.weight, model.bias), "doc_id long, score double, predicted int")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scores = toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
