"""License scans by ordered signature rules, in DataFrame expressions only: one projection, no shuffle.

A text's words are matched against some hundreds of signatures, each the product of a license's name in words and a phrasing.
Further signatures are sentences of the licenses' own texts. A text without a keyword of any license skips them all; a rule whose own keyword is absent is skipped. Detections are word
intervals; one that lies inside another is suppressed, of equal intervals the one of higher priority stays. Base phrases are
counted apart and never suppressed.

Nulls: a null text is empty, with no words and no labels; ids are passed on. Repeated rows give repeated results, an empty
table an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: What parts words once A-Z are lower case.
#: Parts words, so that no word has it.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARK = "\x01"
#: Detections that are looked through at a time, which bounds what each step copies.
CHUNK = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, keyword, name in words (regular expression)
NAMES = [
    ("mit", "mit", "mit licen[cs]e"), ("mit", "expat", "expat licen[cs]e"), ("mit-0", "attribution", "mit no attribution(?: license)?"), ("isc", "isc", "isc licen[cs]e"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e(?: version)? 1 1"), ("apache-2.0", "apache", "apache (?:software )?licen[cs]e(?: version)? 2(?: 0)?"), ("apache", "apache", "apache (?:software )?licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?"), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|original bsd)(?: licen[cs]e)?"), ("bsd", "bsd", "bsd licen[cs]e"), ("0bsd", "bsd", "(?:0bsd|zero clause bsd)(?: licen[cs]e)?"),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e(?: version)? 1 0"), ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version)? 1 1"), ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version)? 2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version)? 1(?: 0)?"), ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version)? 2(?: 0)?"), ("eupl-1.1", "european", "european union public licen[cs]e(?: version)? 1 1"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version)? 1 2"), ("cddl-1.0", "common development", "common development and distribution licen[cs]e(?: version)?(?: 1 0)?"), ("cpl-1.0", "common public", "common public licen[cs]e(?: version)?(?: 1 0)?"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version)?(?: 1 0)?"), ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version)? 2(?: 0)?"), ("afl-3.0", "academic free", "academic free licen[cs]e(?: version)?(?: 3 0)?"),
    ("osl-3.0", "open software", "open software licen[cs]e(?: version)?(?: 3 0)?"), ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"), ("bsl-1.0", "boost", "boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("psf-2.0", "python", "python(?: software foundation)? licen[cs]e(?: version)?(?: 2(?: 0)?)?"), ("php-3.01", "php", "php licen[cs]e(?: version)?(?: 3 01)?"), ("ruby", "ruby", "ruby licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"), ("openssl", "openssl", "openssl licen[cs]e"), ("ms-pl", "microsoft", "microsoft public licen[cs]e"), ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?"), ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl(?: licen[cs]e)?"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version)?(?: 2 1)?"), ("zpl-2.1", "zope", "zope public licen[cs]e(?: version)?(?: 2 1)?"), ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("upl-1.0", "universal permissive", "universal permissive licen[cs]e(?: version)?(?: 1 0)?"), ("busl-1.1", "business source", "business source licen[cs]e(?: version)?(?: 1 1)?"), ("sspl-1.0", "server side", "server side public licen[cs]e(?: version)?(?: 1)?"),
    ("elastic-2.0", "elastic", "elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?"), ("odbl-1.0", "database", "open database licen[cs]e(?: version)?(?: 1 0)?"), ("pddl-1.0", "public domain", "public domain dedication and licen[cs]e(?: version)?(?: 1 0)?"),
    ("gfdl-1.3", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version)?(?: 1 3)?"), ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"), ("x11", "x11", "x11 licen[cs]e"), ("vim", "vim", "vim licen[cs]e"),
]
# Label, keyword and sentence of license texts and of the notices that they ask for.
TEXTS = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "distribute this software", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify"),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify"),
    ("gpl", "permitted to copy and distribute verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
)
#: phrasing around a name, priority, confidence
PHRASINGS = (("{}", 1, 0.7), ("licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{}", 3, 0.95), ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{}", 2, 0.9), ("spdx licen[cs]e identifier {}", 4, 1.0))
#: Every rule's text holds one of these, its words parted by any separators.
GATE = (*[gate for _, gate, _ in TEXTS], "licen", "cc by", "creative commons", "mit no attribution", "cc0", "wtfpl", "spdx", "bsd", "gpl", "ncsa", "cecill")


def names() -> list[tuple[str, str, str]]:
    """NAMES and the families that come in versions: the GNU licenses and the Creative Commons ones."""
    out = list(NAMES)
    for short, long, versions in (("gpl", "general public licen[cs]e", ("1", "2", "3")), ("lgpl", "lesser general public licen[cs]e", ("2", "2 1", "3")), ("agpl", "affero general public licen[cs]e", ("1", "3"))):
        for words, keyword in ((f"(?:gnu )?{long}", "general public"), (short, short)):
            out += [(f"{short}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", keyword, rf"{words}(?: version)? v?{v}(?: 0)?") for v in versions]
            out.append((short, keyword, words))
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        full = parts.replace("by", "attribution").replace("sa", "share ?alike").replace("nc", "non ?commercial").replace("nd", "no ?deriv(?:ative)?s?(?: works)?")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            label = f"cc-{parts.replace(' ', '-')}-{v}"
            out += [(label, "cc by", f"cc {parts} {v.replace('.', ' ')}"), (label, "creative commons", f"creative commons {full} {v.replace('.', ' ')}")]
    return out


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, expression over words joined by spaces, label, priority, confidence)."""
    named = [(keyword, f"(?<= ){phrase.format(name)}(?= )", label, priority, sure) for label, keyword, name in names() for phrase, priority, sure in PHRASINGS]
    return named + [(keyword, f"(?<= ){sentence}(?= )", label, 5, 0.95) for label, keyword, sentence in TEXTS]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(norm: Column, expression: Column) -> Column:
    """Word intervals (first, end) of every match; `norm` has one space before each word and after the last."""
    found = F.regexp_extract_all(norm, expression, F.lit(0))
    # the first word of each match is marked, so that places are read off the words in one go
    words = F.split(F.regexp_replace(norm, expression, F.lit(f"{MARK}$0")), F.lit(" "), -1)
    firsts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i - 1)), lambda i: i.isNotNull())
    both = F.zip_with(firsts, found, lambda i, f: F.struct(i.cast("long").alias("first"), (i + _spaces(f) + 1).cast("long").alias("end")))
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)")
    return F.when(F.rlike(norm, expression), both).otherwise(none)


def license_labels(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row for each row of `docs`.

    detections: the intervals that stay, as structs of first, end (words from 0, end exclusive), label, priority and confidence.
    """
    lower = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower()).alias("lower"))
    gate = F.lit(False)
    for words in map(str.split, GATE):
        parted = [F.rlike("lower", F.lit(SEPARATORS.join(words)))] if len(words) > 1 else []
        gate = gate | reduce(Column.__and__, [F.contains("lower", F.lit(w)) for w in words] + parted)
    base_rules = F.array(*[F.struct(F.lit(f"(?<= ){p}(?= )").alias("expression"), F.lit(label).alias("label")) for p, label in BASE])
    more_rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("keyword", "expression", "label", "priority", "sure"), r)]) for r in rules()])
    normal = lower.select("doc_id", F.regexp_count("lower", F.lit(WORDS)).cast("long").alias("n_words"), F.when(gate, F.concat(F.lit(" "), F.trim(F.regexp_replace("lower", SEPARATORS, " ")), F.lit(" "))).alias("norm"))
    base = F.flatten(F.transform(base_rules, lambda r: F.transform(_places(F.col("norm"), r["expression"]), lambda p: F.struct(p["first"].alias("first"), r["label"].alias("label")))))
    spans = F.flatten(
        F.transform(
            F.filter(more_rules, lambda r: F.contains(F.col("norm"), r["keyword"])),
            lambda r: F.transform(
                _places(F.col("norm"), r["expression"]),
                lambda p: F.struct(p["first"].alias("first"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["label"].alias("label"), r["sure"].cast("double").alias("sure")),
            ),
        )
    )
    found = normal.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), base).alias("base"), F.when(F.col("norm").isNotNull(), F.array_sort(spans)).alias("spans"))
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint,label:string,priority:int,sure:double>>)")
    many = F.expr("cast(array() as array<array<struct<first:bigint,end:bigint,label:string,priority:int,sure:double>>>)")
    zero = F.struct(F.lit(0).cast("long").alias("reach"), many.alias("chunks"))

    def stay(acc, s):
        one = F.struct(s["first"].alias("first"), (-s["minus_end"]).alias("end"), s["label"].alias("label"), (-s["minus_priority"]).alias("priority"), s["sure"].alias("sure"))
        return F.when(-s["minus_end"] <= acc["reach"], acc).otherwise(F.struct((-s["minus_end"]).alias("reach"), acc["chunks"].alias("chunks"), F.concat(acc["out"], F.array(one)).alias("out")))

    def chunk(acc, i):
        begin = F.struct(acc["reach"].alias("reach"), acc["chunks"].alias("chunks"), none.alias("out"))
        return F.aggregate(F.slice("spans", i * CHUNK + 1, F.lit(CHUNK)), begin, stay, lambda x: F.struct(x["reach"].alias("reach"), F.concat(x["chunks"], F.array(x["out"])).alias("chunks")))

    chunks = F.sequence(F.lit(0), F.floor(F.size("spans") / CHUNK).cast("int"))
    kept = found.select("doc_id", "n_words", F.coalesce("base", F.expr("cast(array() as array<struct<first:bigint,label:string>>)")).alias("base"), F.coalesce(F.when(F.size("spans") > 0, F.flatten(F.aggregate(chunks, zero, chunk, lambda acc: acc["chunks"]))), none).alias("kept"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    firsts = F.transform("base", lambda b: b["first"])
    sure = F.coalesce(F.array_max(F.transform("kept", lambda k: k["sure"])), F.lit(0.0))
    return kept.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        listed(F.transform("base", lambda b: b["label"])).alias("base_labels"), listed(F.concat(F.transform("base", lambda b: b["label"]), F.transform("kept", lambda k: k["label"]))).alias("labels"),
        F.greatest(sure, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"), F.col("kept").alias("detections"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents")).drop("detections")
