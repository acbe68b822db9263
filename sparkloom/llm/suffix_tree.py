"""Substring dedup with prefix-partitioned suffix trees.

A window of 50 words is removed if it also starts in a document with a smaller doc_id. Suffixes are split by prefixes of
variable length (see windows.py): the ten words at a window's anchor or, where more than windows.CROWD suffixes share those, 47 words, or
the whole 50 words. Prefix groups are packed into tasks up to windows.CHUNK bytes. There the suffix trees of the groups stand as their suffixes in order with the
common prefixes of neighbours: an internal node is a stretch of suffixes whose common prefixes are all as long as its string depth or longer. Each deep node, of 50 words or more, is a repeat;
its least doc_id decides which of its suffixes go, over the whole depth of the deepest such node, and of those only the
maximal ones are kept, which don't continue the suffix one word ahead."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, carried, own_columns, small, stretch_hashes, utf8, words_of
from sparkloom.llm.windows import Symbols, merged, repeated_windows

WINDOW, PREFIX, STEP = 50, 10, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    begins, ends, edges = words_of(data, offsets)
    return stretch_hashes(data, begins, ends), edges, begins, ends


def _joined_digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


WORDS = Symbols(WINDOW, PREFIX, STEP, word_symbols, _joined_digest)


def sorted_suffixes(words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of texts in order, and the words that each shares with the one ahead, from prefix doubling.

    words: numbers of the words of all texts. left: words from each suffix's start to the end of its text."""
    rank, levels, h = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1, [], 1
    while len(words):
        levels.append((h, rank))
        if h >= left.max():
            break
        follows = np.zeros(len(rank), np.int64)
        follows[:-h] = np.where(left[:-h] > h, rank[h:], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + follows, return_inverse=True)[1].astype(np.int64) + 1
        h *= 2
    order = np.argsort(rank, kind="stable")
    common, a, b = np.zeros(len(order), np.int64), order[:-1], order[1:]
    if len(order):
        most, shared = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
        for h, of_prefix in reversed(levels):
            more = np.flatnonzero(shared < most)
            same = more[of_prefix[a[more] + shared[more]] == of_prefix[b[more] + shared[more]]]
            shared[same] += h
        common[1:] = np.minimum(shared, most)
    return order, common


def deep_repeats(common: np.ndarray, kd: np.ndarray, depth: int) -> np.ndarray:
    """String depth of the deepest internal node, of `depth` or more, in which each of the sorted suffixes meets a smaller kd; 0 without one."""
    found = np.zeros(len(common), np.int64)
    for d in np.unique(common[common >= depth]):
        inside = common >= d
        inside[:-1] |= inside[1:]  # the first suffix of a node shares its prefix with the next
        at = np.flatnonzero(inside)
        head = np.flatnonzero(common[at] < d)
        least = np.repeat(np.minimum.reduceat(kd[at], head), np.diff(np.append(head, len(at))))
        found[at[least < kd[at]]] = d
    return found


def compare(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal repeats of the stretches that a smaller doc_id has, too."""
    n = chunk.column("n").to_numpy().astype(np.int64)
    size = n + WINDOW - 1
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for w in b" ".join(chunk.column("bytes").to_pylist()).split()), np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(n)), size)
    order, common = sorted_suffixes(words, edges[1:][row] - np.arange(len(words)))
    length = np.zeros(len(words), np.int64)
    length[order] = deep_repeats(common, chunk.column("kd").to_numpy()[row[order]], WINDOW)
    ahead = np.zeros(len(words), np.int64)
    ahead[1:] = np.where(row[1:] == row[:-1], length[:-1], 0)
    at = np.flatnonzero((length > 0) & (length >= ahead))
    return row[at], at - edges[row[at]], at - edges[row[at]] + length[at]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 2):
        at, data = utf8(batch.column(2))
        raw, out = data.tobytes(), []
        for i, spans in enumerate(batch.column(3).to_pylist()):
            words, kept, done, removed = raw[at[i] : at[i + 1]].split(), [], 0, 0
            for a, b in merged(spans):
                kept += words[done:a]
                done, removed = b, removed + b - a
            text = b" ".join(kept + words[done:])
            out.append((removed, hashlib.sha256(text).hexdigest(), text.decode()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.string(), pa.string())))], ["kd", "th", "gone", "digest", "cut"])


def dedup_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, n_removed, kept_sha256, and cut: the kept words of a partly removed text (null for any other), for every row.

    Null and empty texts have no words. Fewer than 50 words have no window. A null doc_id counts as larger than all
    others; rows with equal doc_id remove nothing from each other. Repeated rows get equal results. Other columns are ignored."""
    survey, first, found = repeated_windows(docs, WORDS, compare, "least_kd < kd", "least_kd < kd", "trees")
    cut = found.mapInArrow(_cut, "kd long, th long, gone long, digest string, cut string")
    own = first.select("kd", "whole", F.lit(True).alias("is_first"))
    joined = survey.join(own, ["kd", "whole"], "left").join(cut, ["kd", "th"], "left")
    copy = F.col("is_first").isNull() & (F.col("n") >= WINDOW)
    return joined.select(
        "doc_id",
        "th",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("digest", F.lower(F.hex("whole")))).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("cut")).alias("cut"),
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs with the removed words cut out: the text of a document that loses words is its kept words joined by one space, and
    n_chars, where docs has it, its new length. A document that loses all its words goes; null, empty and wordless texts stay as they are."""
    found = dedup_windows(docs).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("th").alias("_th"), "cut").dropDuplicates(["_id", "_th"])
    new = {"text": F.coalesce("cut", F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col("_doc.n_chars")).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    own = [new[c].alias(c) if c in new else x for c, x in zip(docs.columns, own_columns(docs))]
    return carried(docs).join(found, ["_id", "_th"], "left").where("cut is null or cut <> ''").select(*own)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
