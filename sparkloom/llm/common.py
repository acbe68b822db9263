"""Shared helpers: the shared working folder, Arrow text access and numpy rolling hashes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import materialise, shared_dir  # noqa: F401

#: Stands for a null doc_id wherever an order or a join key is needed: nulls come last.
NULL_ID = 2**63 - 1
#: Bytes of text that one numpy step works on; bounds the temporaries of a Python worker.
SLICE_BYTES = 2_000_000


def reach_workers(spark: SparkSession) -> None:
    """Have Python workers look for this library where the driver found it, too. On a cluster it is installed or sent with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The whole text as a string, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def carried(docs: DataFrame) -> DataFrame:
    """Every row of docs whole in `_doc`, which keeps its columns apart from any of ours, with `_id` (doc_id, null as NULL_ID) and `_th` (64-bit hash of the text)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text_of(docs)).alias("_th"))


def own_columns(docs: DataFrame, *but: str) -> list[Column]:
    """The columns of docs out of `_doc`, without those named."""
    return [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in but]


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the number as decimal text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the data bytes of an Arrow string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or data is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most `most` bytes, or are a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def small(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column `text` holds at most `most` bytes, or that are a single row."""
    for batch in batches:
        for lo, hi in slices(utf8(batch.column(text))[0], most):
            yield batch.slice(lo, hi - lo)


BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n; kept for sizes up to a few slices."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _TABLES:
        pair = []
        for b in (BASE, _INVERSE):
            p, k = np.ones(size, np.uint64), 1
            with np.errstate(over="ignore"):
                while k < size:
                    p[k : 2 * k] = p[:k] * (p[k - 1] * b)
                    k *= 2
            pair.append(p)
        if size > 4 * SLICE_BYTES:
            return pair[0], pair[1]
        _TABLES.clear()
        _TABLES[size] = (pair[0], pair[1])
    return _TABLES[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor) that spreads low-entropy hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_filter(keys: DataFrame, bits: int, most: int) -> np.ndarray:
    """A filter of `key`, as 64-bit words: `bits` bits a row in a power of two, `most` bits at most, in which each key sets the bit that its low bits name."""
    size = 1 << 10
    while size < min(most, bits * keys.count()) // 64:
        size *= 2
    word = F.shiftright("key", 6).bitwiseAND(F.lit(size - 1)).alias("word")
    rows = keys.select(word, F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (unsigned) have their bit set in the filter."""
    return (bits[(keys >> np.uint64(6) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


class Rolling:
    """Content hashes of any stretch of a symbol array, from one pass of prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.up, self.down = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[: len(symbols)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[stop] - self.sums[start]) * self.down[start]
            return mix(raw + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


def stretch_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hashes of stretches in ascending order that don't overlap, in steps of bounded memory."""
    out, lo, n = np.zeros(len(begins), np.uint64), 0, len(begins)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + SLICE_BYTES, "right")))
        base = int(begins[lo])
        if ends[hi - 1] - base > SLICE_BYTES:  # one very long stretch
            out[lo] = int.from_bytes(hashlib.blake2b(data[base : int(ends[lo])].tobytes(), digest_size=8).digest(), "little")
        else:
            out[lo:hi] = Rolling(data[base : int(ends[hi - 1])])(begins[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of concatenated texts: byte starts, byte ends, and first word of each row (one more)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~blank
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
