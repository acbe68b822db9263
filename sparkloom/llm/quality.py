"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in numpy inside tasks, once. About ROWS labelled training rows, drawn by a hash of doc_id and statistics,
are gathered to grow the trees; each statistic is cut into BINS quantile bins and every split is chosen from gradient histograms. The trees are
full binary trees of depth DEPTH, flattened into arrays, so scoring is DEPTH vectorised steps per tree for a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc_mod, materialise, small, stretch_hashes, text_of, utf8, words_of

ROWS, BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 20_000, 64, 4, 80, 0.15, 5, 1.0
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "stops", "signs", "beyond_ascii", "lines", "distinct_words", "top_word",
    "repeated_ahead", "short_words", "no_letter_words", "sentence_ends", "capitals", "distinct_pairs", "sign_ends", "long_words", "line_length", "distinct_lines",
)


def _distinct(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys of each row, and times of the most frequent one."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((keys, row))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])
    starts = np.flatnonzero(new)
    times, most = np.diff(np.append(starts, len(keys))), np.zeros(len(edges) - 1, np.int64)
    np.maximum.at(most, row[order][starts], times)
    return np.bincount(row[order][starts], minlength=len(edges) - 1), most


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of each text as a row; zeros for an empty one."""
    at, data = utf8(column)
    begins, ends, edges = words_of(data, at)
    n, w = np.diff(at), np.diff(edges)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[at[1:]] - c[at[:-1]]

    def of_words(value: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(value)])
        return (c[edges[1:]] - c[edges[:-1]]) / np.maximum(w, 1)

    per_byte = 1 / np.maximum(n, 1)
    upper, lower, digit = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57)
    stop = np.isin(data, np.frombuffer(b".,;:!?'\"-()", np.uint8))
    high = data >= 128
    sign = (data > 32) & ~upper & ~lower & ~digit & ~stop & ~high
    size = ends - begins
    hashes = stretch_hashes(data, begins, ends)
    letters = np.concatenate([[0], np.cumsum(upper | lower | high)])
    inner = np.ones(len(hashes), bool)
    inner[edges[:-1][w > 0]] = False
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    with np.errstate(over="ignore"):
        pair = hashes * np.uint64(3) + np.concatenate([[np.uint64(0)], hashes[:-1]]) if len(hashes) else hashes
    words, top = _distinct(hashes, edges)
    pairs, _ = _distinct(np.where(inner, pair, hashes), edges)
    final = data[ends - 1] if len(ends) else data[:0]
    start = data[begins] if len(begins) else data[:0]
    # lines: stretches between line feeds, by row
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    feed = data == 10
    opens = ~feed & (np.concatenate([[True], feed[:-1]])[: len(data)] | edge[:-1])
    closes = ~feed & (np.concatenate([feed[1:], [True]])[: len(data)] | edge[1:])
    line_begin, line_end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    line_edges = np.searchsorted(line_begin, at)
    lines, _ = _distinct(stretch_hashes(data, line_begin, line_end), line_edges)
    m = np.diff(line_edges)
    return np.stack(
        [
            np.log1p(of_bytes((data & 0xC0) != 0x80)), np.log1p(w), of_words(size), of_bytes(upper) * per_byte, of_bytes(digit) * per_byte, of_bytes(stop) * per_byte,
            of_bytes(sign) * per_byte, of_bytes(high) * per_byte, of_bytes(feed) / np.maximum(w, 1), words / np.maximum(w, 1), top / np.maximum(w, 1), of_words(same & inner),
            of_words(size <= 3), of_words(letters[ends] == letters[begins]), of_words(np.isin(final, np.frombuffer(b".!?", np.uint8))), of_words((start >= 65) & (start <= 90)),
            pairs / np.maximum(w, 1), of_words((final > 32) & (final < 48)), of_words(size > 12), np.log1p(n / np.maximum(m, 1)), lines / np.maximum(m, 1),
        ],
        1,
    ).astype(float)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 1):
        x = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i].astype(np.float32)) for i in range(x.shape[1]))], ["doc_id", *STATISTICS])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS for every row; a null or empty text has zeros. Other columns are ignored; an empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{x} float" for x in STATISTICS))


@dataclass
class Trees:
    """Inner nodes of all trees in heap order (the children of i are 2i+1 and 2i+2), their leaves, and the offset."""

    feature: np.ndarray  # TREES x (2**DEPTH - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # TREES x 2**DEPTH
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.offset), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss. Without rows of both labels: no trees and the one label's rate."""
    inner = 2**DEPTH - 1
    rate = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return trees
    f = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # value > cuts[b] just if bin > b
    total = np.full(len(y), trees.offset)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, m = 2**depth - 1, 2**depth
            cell = (((node - first) * f)[:, None] + np.arange(f)) * BINS + binned
            g, h, c = (np.bincount(cell.ravel(), np.repeat(v, f), m * f * BINS).reshape(m, f, BINS).cumsum(2) for v in (slope, bend, np.ones(len(y))))
            gl, hl, cl = g[:, :, :-1], h[:, :, :-1], c[:, :, :-1]
            gr, hr, cr = g[:, :, -1:] - gl, h[:, :, -1:] - hl, c[:, :, -1:] - cl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + RIDGE)
            gain[(cl < LEAST) | (cr < LEAST)] = -1
            best = gain.reshape(m, -1).argmax(1)
            for i in range(m):
                j, b = divmod(int(best[i]), BINS - 1)
                if gain[i, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        g, h = np.bincount(node - inner, slope, inner + 1), np.bincount(node - inner, bend, inner + 1)
        leaf = RATE * g / (h + RIDGE)
        total += leaf[node - inner]
        trees.feature, trees.threshold, trees.leaf = np.vstack([trees.feature, feature]), np.vstack([trees.threshold, threshold]), np.vstack([trees.leaf, leaf])
    return trees


def fit(measured: DataFrame, labels: DataFrame) -> Trees:
    """Trees of labelled rows whose crc32 remainder isn't the held-out one. Labels by a null doc_id or of null quality are ignored;
    of several labels of a doc_id the highest holds; rows that repeat a doc_id and its statistics count once."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null")
    own = own.where(crc_mod("doc_id", FOLDS) != HELD_OUT).groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    labelled = materialise(measured.join(own, "doc_id").select("label", *STATISTICS, F.xxhash64("doc_id", *STATISTICS).alias("draw")).distinct(), "quality-labelled")
    share = ROWS / max(labelled.count(), 1)
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)).orderBy("draw", "label", *STATISTICS)
    rows = drawn.select("label", *STATISTICS).toPandas().to_numpy(float).reshape(-1, 1 + len(STATISTICS))
    return grow(rows[:, 1:], rows[:, 0])


def _score(trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 1 + len(STATISTICS))], 1).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.value.score(x))], ["doc_id", "score"])

    return run


def score_quality(measured: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score for every row of `measure`. Null and empty texts are scored by statistics of zero."""
    shared = measured.sparkSession.sparkContext.broadcast(trees)
    return measured.select("doc_id", *STATISTICS).mapInArrow(_score(shared), "doc_id long, score double")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    measured = materialise(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality")
    scored = score_quality(measured, fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
