"""Suffix-array dedup by merging Burrows-Wheeler transforms of shards.

Every byte covered by a 200-byte string that also starts elsewhere is removed. The stretches of one anchor (windows.py) hold
all occurrences of their windows, aligned at the anchor, so each stretch is read as 8-byte blocks in step with its anchor. The stretches of
a task are cut into shards. A shard's suffixes are sorted once and its transform, the block before each suffix, written down in that order. The shards
are then merged without sorting their suffixes again: the interleave, which says from which shard the next suffix comes, starts as
the shards in turn, and each round deals it stably by the transform's block, which puts suffixes in order of one more block.
A boundary that appears in round h marks a common prefix of h - 1 blocks, and after 24 rounds the stretches of the merged order without a boundary are the
repeated intervals. A window is 24 such blocks with eight more bytes around them, by which its interval is split."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import small, utf8
from sparkloom.llm.windows import Symbols, merged, repeated_windows, runs_of

WINDOW, GRAM, STEP, BLOCK = 200, 32, 43, 8
#: Blocks that every window contains whole, wherever it starts.
DEPTH = WINDOW // BLOCK - 1
#: Blocks of a shard.
SHARD = 1 << 17
EMPTY = hashlib.sha256(b"").hexdigest()


def byte_symbols(data: np.ndarray, offsets: np.ndarray):
    return data, offsets, None, None


BYTES = Symbols(WINDOW, GRAM, STEP, byte_symbols, lambda text: hashlib.sha256(text).digest())


def shard_order(block: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in order of their first `depth` blocks. left: blocks from each suffix to the end of its text; 0 for the empty suffix."""
    rank, h = np.where(left > 0, block, 0).astype(np.int64), 1
    while h < depth:
        step = min(h, depth - h)
        follows = np.zeros(len(rank), np.int64)
        follows[:-step] = np.where(left[:-step] > step, rank[step:], 0)
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + follows, return_inverse=True)[1].astype(np.int64)
        rank += 1
        rank[left == 0] = 0
        h += step
    return np.argsort(rank, kind="stable")


def merge_transforms(before: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of sorted shards and the common prefixes of neighbours.

    before: each shard's transform, the block before each suffix in the shard's order, 0 before a whole text. The second
    result has, for each suffix of the merged order, the blocks that it shares with the one ahead, `depth` at most."""
    source = np.repeat(np.arange(len(before), dtype=np.int16), [len(x) for x in before])
    blocks = np.concatenate(before)
    group = np.zeros(len(source), np.int64)
    common = np.full(len(source), depth, np.int64)
    for h in range(depth):
        taken = np.empty(len(source), blocks.dtype)
        taken[np.argsort(source, kind="stable")] = blocks
        dealt = np.argsort(taken, kind="stable")
        source, taken, group = source[dealt], taken[dealt], group[dealt]
        # the empty suffixes, dealt from block 0, have no block by which they could differ
        edge = np.concatenate([[True], (taken[1:] != taken[:-1]) | ((taken[1:] != 0) & (group[1:] != group[:-1]))])
        common[edge & (common == depth)] = h
        group = np.cumsum(edge)
    return source, common


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number."""
    view = np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))
    return view[at].astype(np.uint64)


def compare(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the stretches whose 200 bytes occur in the chunk more than once."""
    n, p = chunk.column("n").to_numpy().astype(np.int64), chunk.column("p").to_numpy().astype(np.int64)
    at, data = utf8(chunk.column("bytes").combine_chunks())
    phase = p % BLOCK
    count = (np.diff(at) - phase) // BLOCK
    own = np.repeat(np.arange(len(n)), count + 1)  # every block, and the empty suffix, of every stretch
    edges = np.concatenate([[0], np.cumsum(count + 1)])
    j = np.arange(edges[-1]) - edges[own]
    real = j < count[own]
    block = np.zeros(edges[-1], np.int32)
    block[real] = np.unique(_words_at(data, (at[own] + phase[own] + BLOCK * j)[real]), return_inverse=True)[1] + 1
    left = count[own] - j
    orders, before, base = [], [], 0
    for stop in [*(int(x) for x in edges[1:][np.flatnonzero(np.diff(edges[1:] // SHARD))]), int(edges[-1])]:
        if stop > base:
            order = shard_order(block[base:stop], left[base:stop], DEPTH) + base
            orders.append(order)
            before.append(np.where(j[order] > 0, block[order - 1], 0).astype(np.int32))
            base = stop
    source, common = merge_transforms(before, DEPTH)
    suffix = np.empty(len(source), np.int64)
    suffix[np.argsort(source, kind="stable")] = np.concatenate(orders)
    interval = np.empty(len(source), np.int64)
    interval[suffix] = np.cumsum(common < DEPTH)
    repeated = np.bincount(interval)[interval] > 1

    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    ahead = (p[row] - start) % BLOCK  # bytes of the window before its first whole block
    first = edges[row] + (start + ahead - phase[row]) // BLOCK
    some = repeated[first]
    row, start, ahead, first = row[some], start[some], ahead[some], first[some]
    low = (~np.uint64(0)) >> (np.uint64(8) * ahead.astype(np.uint64)).clip(0, 63)
    around = (_words_at(data, at[row] + start) & ~low) | (_words_at(data, at[row] + start + WINDOW - 8) & low)
    node = interval[first] * BLOCK + ahead
    order = np.lexsort((around, node))
    same = (node[order][1:] == node[order][:-1]) & (around[order][1:] == around[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return runs_of(row[twice], start[twice], WINDOW)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 2):
        at, data = utf8(batch.column(2))
        raw, out = data.tobytes(), []
        for i, spans in enumerate(batch.column(3).to_pylist()):
            text, gone = raw[at[i] : at[i + 1]], merged(spans)
            ends = [0, *(x for ab in gone for x in ab), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
            out.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in gone]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds))], ["kd", "th", "gone", "runs", "digest", "spans"])


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges of a partly removed text, else null), for every row.

    Null and empty texts have no bytes. Fewer than 200 bytes have no window. Equal texts of 200 bytes or more remove each other
    whole, repeated rows of one doc_id included; a null doc_id makes no difference. Other columns are ignored."""
    survey, first, found = repeated_windows(docs, BYTES, compare, "copies > 1", "true", "transforms")
    cut = found.mapInArrow(_cut, "kd long, th long, gone long, runs long, digest string, spans array<struct<a: long, b: long>>")
    joined = survey.join(first, ["kd", "whole"], "left").join(cut, ["kd", "th"], "left")
    copy = (F.coalesce("copies", F.lit(2)) > 1) & (F.col("n") >= WINDOW)
    return joined.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("digest", F.lower(F.hex("whole")))).alias("kept_sha256"),
        F.when(~copy, F.col("spans")).alias("spans"),
    )


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
