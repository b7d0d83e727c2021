"""Secrets: Aho-Corasick keyword prefilter, anchored expressions at the hits, then embedded checksums.

Three base kinds are always reported: assign (a name like password or token, a sign, a value), access (AKIA keys) and hex
(long runs of hex digits). Further kinds come from formats that prove themselves: tokens whose last six characters are the
base-62 CRC-32 of the rest (github, npm), JSON web tokens whose head decodes to JSON with an algorithm, private-key blocks,
and slack and stripe tokens by form. Spans count code points of the whole text, ends exclusive.

A text is read in time linear in its length: hits inside a run that has failed are passed over. A web token's head of more than
LONGEST_HEAD characters, or nested deeper than the JSON reader goes, fails its check.

Nulls: a null text is empty and has no span; ids are passed on as they are. Repeated rows give repeated results, an empty
table an empty one, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, each_text, table, texts_of

OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_more", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
BASE = ("assign", "access", "hex")
#: Kinds in the order in which spans with one start are listed.
KINDS = (*BASE, "github", "npm", "jwt", "private_key", "slack", "stripe")
RANK = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = re.compile(r"[0-9a-f]{32,}")
#: kind: (prefilter keywords in lower case, expression tried at each hit, minimum length of the match)
AT_HITS = {
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), 40),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), 30),
    "private_key": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"), 60),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(r"xox[bpar]-[0-9]{8,}-[A-Za-z0-9-]{10,}"), 24),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{20,}"), 28),
}
#: A token's characters; a token that can't be matched from its first keyword on can't be from another in the same run of them.
TOKEN_RUN = re.compile(r"[A-Za-z0-9_-]+")
#: Characters of a JSON web token's head, beyond which it is no token: real ones have about a hundred.
LONGEST_HEAD = 4096
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(width, "0")


def checks(kind: str, found: str) -> bool:
    """Whether what the format embeds about itself holds."""
    if kind in ("github", "npm"):
        return found[-6:] == base62(zlib.crc32(found[4:-6].encode()))
    if kind == "jwt":
        head = found.split(".")[0]
        if len(head) > LONGEST_HEAD:
            return False
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, TypeError, RecursionError):
            return False
    return True


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        out.add_word(word, ("assign", len(word)))
    for kind, (words, _, _) in AT_HITS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret of one text, by start, then kind."""
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {}
    for last, (kind, size) in keywords.iter(lower):
        starts.setdefault(kind, []).append(last - size + 1)
    out = [(*m.span(), "hex") for m in HEX.finditer(text)]
    for kind, at in starts.items():
        pattern, least = (ASSIGN, 8) if kind == "assign" else AT_HITS[kind][1:]
        end = 0
        for start in sorted(at):
            if start < end:
                continue
            if not (m := pattern.match(text, start)):
                if kind == "jwt" and (run := TOKEN_RUN.match(text, start)):
                    end = run.end()
                continue
            end = m.end()
            size = len(m[1]) if kind == "assign" else len(m[0])
            if size >= least and checks(kind, m[0]):
                out.append((start, end, kind))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches):
    keywords = automaton()
    for r in each_text(batches):
        found = [find(t, keywords) for t in texts_of(r.column(1))]
        counts = {f"n_{k}": [sum(s[2] == k for s in spans) for spans in found] for k in BASE}
        yield batch(OUT, {
            "doc_id": r.column(0), **counts, "n_more": [sum(RANK[s[2]] >= len(BASE) for s in spans) for spans in found],
            "base_sha256": [hashlib.sha256(joined([s for s in spans if RANK[s[2]] < len(BASE)]).encode()).hexdigest() for spans in found],
            "spans": [joined(spans) for spans in found],
        })


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_more, base_sha256, spans), one row for each row of `docs`."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_more long, base_sha256 string, spans string")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
