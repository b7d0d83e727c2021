"""Texts made to crash or to take the square of their length, and names that clash with those used inside."""

import base64
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestock.llm import exact_dedup, licenses, line_dedup, mixing, ngram_join, packing, quality, secrets

from .test_llm_operators import docs


def test_packing_reads_any_text(spark):
    """Megabytes of white space or of one letter, and the string of a special token: the ids of the tokenizer file as it stands."""
    texts = ["\n" * 2_000_000, " \t" * 300_000 + "end", "a" * 500_000, "<|endoftext|> hi <|endoftext|>", "plain text"]
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs(spark, list(enumerate(texts)))).collect()
    for i, text in enumerate(texts):
        ids = np.array([*reader.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def part(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def test_secrets_of_nested_heads():
    keywords = secrets.automaton()
    for depth in (900, 60_000):
        head = part(b'{"a":' * depth + b"1" + b"}" * depth)
        assert head.startswith("eyJ") and not [s for s in secrets.find(f"{head}.eyJhIjoxfQ.abc", keywords) if s[2] == "jwt"]
    good = part(json.dumps({"alg": "HS256"}).encode())
    assert [s[2] for s in secrets.find(f"x {good}.eyJhIjoxfQ.abc y", keywords)] == ["jwt"]


def test_secrets_in_linear_time():
    keywords, took = secrets.automaton(), []
    for n in (50_000, 400_000):
        t = time.process_time()
        secrets.find("eyJ" * n, keywords)
        secrets.find("AKIA" * n + " " + "password" * n + " " + "xoxb-1" * n, keywords)
        took.append(time.process_time() - t)
    assert took[1] < 40 * max(took[0], 0.02)


def test_licenses_in_many_places(spark):
    """Every place is found, and twenty thousand of them take no square of a thousand's time."""
    rows = [(1, "mit license " * 20_000), (2, "the mit license, or Apache\nLicense 2.0; mit license")]
    t = time.time()
    out = {r["doc_id"]: r for r in licenses.license_labels(docs(spark, rows)).collect()}
    assert time.time() - t < 40
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], len(out[1]["detections"])) == (20_000, 0, 39_998, 20_000)
    assert (out[2]["n_base"], out[2]["first_word"], out[2]["last_word"], out[2]["labels"]) == (3, 1, 8, "apache,apache-2.0,mit")


def test_license_texts(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
    rows = [(1, notice), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (3, "you may not use this file except in compliance with the License."), (4, "nothing"), (5, "the MİT LİCENSE of K")]
    out = {r["doc_id"]: r["labels"] for r in licenses.license_labels(docs(spark, rows)).collect()}
    assert out == {1: "mit", 2: "bsd", 3: "apache-2.0", 4: "", 5: ""}


def test_names_that_clash(spark):
    """Columns named like those used inside change no result and come through where an operator returns its input's columns."""
    inside = "cdf rate_of rate_least rate_cdf salt salt_of least rows rate __id __source __salt removed_of digest body v p h n prefix outline piece bin leaf open fill shift best labelled score".split()
    rows = docs(spark, [(i, f"line one of {i % 3}\nand some more words follow here {i % 3}") for i in range(12)])
    frame = rows.select(*rows.columns, *[F.lit("x").alias(c) for c in inside if c not in rows.columns])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for run in (mixing.mix_sources, line_dedup.dedup_lines, ngram_join.ngram_components, packing.pack_documents, exact_dedup.exact_dedup, secrets.secret_spans, licenses.license_labels, lambda d: quality.keep_good(d, labels)):
        plain, clashing = run(rows), run(frame)
        same = [c for c in plain.columns if c not in ("sequence_id", "offset")]
        assert sorted(map(str, plain.select(same).collect())) == sorted(map(str, clashing.select(same).collect()))


def test_keys_of_long_lines_are_linear():
    """However frequent its words, a line of n words has some n keys."""
    rng = np.random.default_rng(5)
    for n in (20, 24, 39, 40, 79, 100, 159, 160, 300, 1000):
        h = rng.integers(1, 1 << 63, n).astype(np.uint64)
        level = np.full(n, 1 + int(line_dedup.FINE * np.log2(1e6)), np.uint8)
        key, _, _ = line_dedup.keys_of(np.array([n]), h, level, np.zeros(n, np.int64), np.ones(1, bool), 80, 1024, 1e7)
        assert len(key) < 16 * n if n < line_dedup.LONG else len(key) < 2 * n


def test_matching_lines_share_a_key():
    rng = random.Random(11)
    for _ in range(150):
        words = [rng.getrandbits(64) for _ in range(rng.choice([60, 400]))]
        often = {w: rng.choice([2, 30, 90, 120]) for w in words}
        size = min(rng.choice([10, 22, 33, 38, 42, 66, 78, 84, 130, 150, 165, 200]), len(words) - 20)
        base = rng.sample(words, size)
        sets = [set(base)]
        for _ in range(5):
            s = set(base)
            for _ in range(rng.randrange(1 + size // 6)):
                s ^= {rng.choice(words)}
            sets.append(s)
        flat = [(i, w) for i, s in enumerate(sets) for w in sorted(s, key=lambda w: (often[w], w))]
        line, h, level = np.array([i for i, _ in flat]), np.array([w for _, w in flat], dtype=np.uint64), np.array([often[w] for _, w in flat], dtype=np.uint8)
        key, of, _ = line_dedup.keys_of(np.array([len(s) for s in sets]), h, level, line, np.ones(len(sets), bool), 80, rng.choice([1, 50, 1024]), rng.choice([1e3, 1e5, 1e7]))
        keys = [set(key[of == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                assert a == b or 100 * len(a & b) < 80 * len(a | b) or keys[i] & keys[j]


def test_lines_of_one_long_template(spark):
    """Twenty thousand lines of three hundred words, of which one is each line's own: all but the first go."""
    text = " ".join(f"word{i}" for i in range(299))
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{text} id"), "id").alias("text")).repartition(8)
    t = time.time()
    removed = line_dedup.removed_lines(rows)
    assert removed.count() == 19_999 and removed.agg(F.min("doc_id")).first()[0] == 1
    assert time.time() - t < 400
