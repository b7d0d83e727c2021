"""Best-fit packing by hierarchical residual packing.

A task cuts documents into pieces and packs its pieces best-fit, longest first; a bin that reaches `full` tokens is emitted.
Of the rest at most one is no more than half full, since two such would have gone together, and only such bins can still
move. So a group hands on its small bin and the few emptiest others, as hosts, and emits the rest; groups of `FAN` are then
merged round by round, underfull bins packed as items. A group of a round holds at most FAN * (FAN + 1) bins, whatever the
input.

Texts of any kind are read whole: long runs of white space, of one character, the strings of special tokens.

Nulls: a null text is empty and makes a piece of the closing id alone; a null id is passed on. Repeated rows are packed each.
An empty table gives an empty result; other columns are not read. Texts longer than a sequence are cut so that only the first
piece is shorter.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, each_text, table, texts_of, written

SIZE = 2048
#: White space from which on a text is read by tokenizers.
BLANK, LONG_BLANK = re.compile(r"\s+"), 20_000
#: Groups that one round merges into one, and hosts that a group hands on.
FAN = 8
#: Bins that a task packs at a time; longer inputs make several groups.
LEAF_PIECES = 60_000
PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "leaf")] + [("open", pa.bool_())])
OPEN = "leaf long, fill long, parts array<struct<bin:long,shift:long>>"
MERGED = pa.schema([("leaf", pa.int64()), ("fill", pa.int64()), ("parts", pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))), ("open", pa.bool_())])


def encoder(vocabulary: str | None):
    """Text to ids as the tokenizer file gives them without special tokens added; a special token's string in a text is that token.

    For the default file most texts go through tiktoken over the same vocabulary, which gives the same ids four times faster. Texts
    with a special token's string, and texts with white space so long that its expressions overflow their stack, go through tokenizers.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    if vocabulary:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) > LONG_BLANK and max(map(len, BLANK.findall(text)), default=0) > LONG_BLANK:
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def best_fit(sizes: list[int], size: int = SIZE) -> list[int]:
    """A bin's number for each item: longest first, each into the fullest bin that has room for it."""
    bins: list[int] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    at = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        j = bisect_left(room, (sizes[i], -1))
        if j == len(room):
            free, b = size, len(bins)
            bins.append(0)
        else:
            free, b = room.pop(j)
        bins[b] += sizes[i]
        at[i] = b
        if free > sizes[i]:
            insort(room, (free - sizes[i], b))
    return at


def handed_on(fills: list[int], full: int, size: int = SIZE) -> set[int]:
    """Which of a group's packed bins go to the next round: those that are half full or less, and the FAN emptiest others that aren't full."""
    under = sorted((f, i) for i, f in enumerate(fills) if f < full)
    small = [i for f, i in under if 2 * f <= size]
    return {*small, *[i for f, i in under if 2 * f > size][:FAN]}


def _leaves(size: int, full: int, vocabulary: str | None):
    def pack(pieces: list[list[int]], leaf: int) -> pa.RecordBatch:
        at = best_fit([p[3] for p in pieces], size)
        fills = [0] * (max(at) + 1)
        offsets = []
        for p, b in zip(pieces, at):
            offsets.append(fills[b])
            fills[b] += p[3]
        on = handed_on(fills, full, size)
        columns = list(zip(*pieces))
        base = leaf << 20
        return batch(PIECE, dict(zip(PIECE.names, [*columns, [base + b for b in at], offsets, [fills[b] for b in at], [leaf] * len(at), [b in on for b in at]])))

    def leaves(batches):
        encode, pieces = encoder(vocabulary), []
        leaf = TaskContext.get().partitionId() << 12
        for r in each_text(batches):
            for doc_id, text in zip(r.column(0).to_pylist(), texts_of(r.column(1))):
                ids = np.array([*encode(text), 0], dtype="<u4")
                ends = list(range(len(ids), 0, -size))[::-1]
                for k, (a, b) in enumerate(zip([0, *ends], ends)):
                    pieces.append([doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())])
            if len(pieces) >= LEAF_PIECES:
                yield pack(pieces, leaf)
                leaf, pieces = leaf + 1, []
        if pieces:
            yield pack(pieces, leaf)

    return leaves


def _merge(size: int, full: int, last: bool):
    def merge(key: tuple[pa.Scalar, ...], groups: pa.Table) -> pa.Table:
        rows = sorted(groups.select(["fill", "parts"]).to_pylist(), key=lambda r: (-r["fill"], r["parts"][0]["bin"]))
        at = best_fit([r["fill"] for r in rows], size)
        bins: list[dict] = [{"fill": 0, "parts": []} for _ in range(max(at) + 1)]
        for r, b in zip(rows, at):
            bins[b]["parts"] += [{"bin": p["bin"], "shift": p["shift"] + bins[b]["fill"]} for p in r["parts"]]
            bins[b]["fill"] += r["fill"]
        on = set() if last else handed_on([b["fill"] for b in bins], full, size)
        return pa.Table.from_pylist([{"leaf": key[0].as_py(), **b, "open": i in on} for i, b in enumerate(bins)], schema=MERGED)

    return merge


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, full: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row a piece."""
    full = size - size // 64 if full is None else full
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in PIECE.names[:-1])
    pieces = written(source.mapInArrow(_leaves(size, full, vocabulary), f"{kinds}, open boolean"), "pieces")
    # a leaf is task << 12 | chunk; numbered without gaps between chunks, neighbours merge
    most = pieces.agg(F.max(F.shiftright("leaf", 12)), F.max(F.col("leaf").bitwiseAND(4095))).first()
    width, chunks = (most[0] or 0) + 1, (most[1] or 0) + 1
    number = F.shiftright("leaf", 12) * chunks + F.col("leaf").bitwiseAND(4095)
    part = F.array(F.struct("bin", F.lit(0).cast("long").alias("shift")))
    now = pieces.where("open and offset = 0").select(number.alias("leaf"), "fill", part.alias("parts"))
    groups, moves = width * chunks, []
    with Scratch(docs.sparkSession) as scratch:
        while True:
            groups = -(-groups // FAN)
            last = groups == 1
            packed = scratch.written(now.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long")).groupBy("leaf").applyInArrow(_merge(size, full, last), OPEN + ", open boolean"), "round")
            moves.append(packed.where("not open"))
            now = packed.where("open").drop("open")
            if last:
                break
        moved = moves[0]
        for m in moves[1:]:
            moved = moved.unionByName(m)
        moved = written(moved, "moved")
    placed = moved.select(F.col("parts")[0]["bin"].alias("sequence_id"), F.explode("parts").alias("p")).select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.shift").alias("shift"))
    return pieces.join(placed, "bin", "left").select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
