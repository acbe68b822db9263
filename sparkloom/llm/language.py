"""Language identification by a linear-chain conditional random field.

Every word is a position of a chain of CHAIN words. Its label scores are sums of learned weights of its features: prefixes and suffixes,
inner byte 2- and 3-grams, and the word itself (lexicon). Learned transitions link neighbours, and
forward-backward over the chain gives each word's label probabilities, so a passage in another language keeps its own labels. The text's language is
the one with the most label probability over words with letters; its share of them is the score.

Weights are fitted on a sample of about ROWS documents of every language, one at least; a document of more than LONGEST characters
is read in PIECES stretches spread over it: about 1.2 MB of text of every language come to the driver, at most. Training goes over the chains in blocks, so its memory doesn't grow with their number times the languages.
Half of the training chains are spliced from two documents, which is what teaches the transitions to switch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SLICE_BYTES, Rolling, crc_mod, small, text_of, utf8, words_of
from sparkloom.llm.toxicity import LOWER

ROWS, LONGEST, PIECES = 150, 8_000, 20
FOLDS, HELD_OUT = 3, 1
CHAIN, TRAIN_CHAIN, BUCKETS, ROUNDS, RATE, RIDGE = 64, 32, 1 << 16, 40, 0.1, 1e-3
AFFIX = 4
#: Label probabilities that a training step or a prediction holds at a time, about.
BLOCK = 1 << 23
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    moves: np.ndarray  # log weight of a label (row) followed by another


def words_and_features(data: np.ndarray, at: np.ndarray):
    """Of texts of bounded size: first word of each row (one more), which words have letters, place of each word among the
    different ones, and the features of those as (word, bucket)."""
    data = LOWER[data]
    begins, ends, edges = words_of(data, at)
    letters = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128))])
    lettered = letters[ends] > letters[begins]
    roll = Rolling(data)
    _, first, place = np.unique(roll(begins, ends), return_index=True, return_inverse=True)
    b, e = begins[first], ends[first]
    word, bucket = [np.arange(len(b))], [roll(b, e, 1)]
    for k in range(1, AFFIX + 1):
        some = np.flatnonzero(e - b >= k)
        word += [some, some]
        bucket += [roll(b[some], b[some] + k, 2), roll(e[some] - k, e[some], 3)]
    for k in (2, 3):
        n = np.maximum(e - b - k + 1, 0)
        own = np.repeat(np.arange(len(b)), n)
        start = b[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        word.append(own)
        bucket.append(roll(start, start + k, 4))
    return edges, lettered, place, np.concatenate(word), (np.concatenate(bucket) & np.uint64(BUCKETS - 1)).astype(np.int64)


def emissions(model: Model, lettered: np.ndarray, place: np.ndarray, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Log label scores of each word; none for words without letters, whose label their neighbours decide."""
    n = int(place.max(initial=-1)) + 1
    own = np.stack([np.bincount(word, model.weights[bucket, c], n) for c in range(len(model.languages))], 1)
    return own[place] * lettered[:, None]


def chains(edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of each chain, padded by the last, and the lengths; no chain crosses a row."""
    n = np.diff(edges)
    parts = -(-n // length)
    row = np.repeat(np.arange(len(n)), parts)
    first = edges[row] + length * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(edges[row + 1] - first, length)
    return first[:, None] + np.minimum(np.arange(length), size[:, None] - 1), size


def forward_backward(scores: np.ndarray, size: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each position (chain, position, label), and expected moves; positions past a chain's size are void."""
    seen = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(moves)
    m, length, k = seen.shape
    ahead, behind = np.empty_like(seen), np.ones_like(seen)
    ahead[:, 0] = seen[:, 0] / seen[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        x = (ahead[:, t - 1] @ step) * seen[:, t]
        ahead[:, t] = x / x.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        x = seen[:, t + 1] * behind[:, t + 1]
        inside = (t + 1 < size)[:, None]
        y = x @ step.T
        behind[:, t] = np.where(inside, y / y.sum(1, keepdims=True), 1)
        a = ahead[:, t] * inside
        expected += (a / np.maximum((a * y).sum(1, keepdims=True), 1e-300)).T @ x * step
    both = ahead * behind
    return both / both.sum(2, keepdims=True), expected


def train(texts: list[str], names: list[str]) -> Model:
    """Adam steps on the conditional log-likelihood of the chains, each word labelled with its document's language."""
    languages = sorted(set(names))
    model = Model(languages, np.zeros((BUCKETS, len(languages))), np.zeros((len(languages), len(languages))))
    at, data = utf8(pa.array(texts, pa.string()))
    if len(languages) < 2 or not len(data):
        return model
    edges, lettered, place, word, bucket = words_and_features(data, at)
    label = np.repeat(np.array([languages.index(x) for x in names]), np.diff(edges))
    at_word, size = chains(edges, TRAIN_CHAIN)
    order = np.random.default_rng(7).permutation(len(at_word))
    at_word, size = at_word[order], size[order]
    half, whole = TRAIN_CHAIN // 2, np.flatnonzero(size == TRAIN_CHAIN)
    one, two = whole[: len(whole) // 4 * 2 : 2], whole[1 : len(whole) // 4 * 2 : 2]
    at_word[one, half:], at_word[two, half:] = at_word[two, half:].copy(), at_word[one, half:].copy()
    inside = np.arange(TRAIN_CHAIN) < size[:, None]
    truth = label[at_word]
    k = len(languages)
    follows = inside[:, 1:]
    moved = np.bincount((truth[:, :-1] * k + truth[:, 1:])[follows], minlength=k * k).reshape(k, k).astype(float)
    total, most, n = inside.sum(), max(1, BLOCK // (TRAIN_CHAIN * k)), int(place.max()) + 1
    slope = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    square = [np.zeros_like(x) for x in slope]
    for i in range(1, ROUNDS + 1):
        own = np.stack([np.bincount(word, model.weights[bucket, c], n) for c in range(k)], 1)
        of_word, expected = np.zeros((n, k)), np.zeros((k, k))
        for lo in range(0, len(at_word), most):
            at, real = at_word[lo : lo + most], inside[lo : lo + most]
            p, moves = forward_backward(own[place[at]] * lettered[at][:, :, None], size[lo : lo + most], model.moves)
            flat, p = at[real], p[real]
            miss = -p
            miss[np.arange(len(flat)), truth[lo : lo + most][real]] += 1
            miss *= lettered[flat][:, None]
            for c in range(k):
                of_word[:, c] += np.bincount(place[flat], miss[:, c], n)
            expected += moves
        up = [np.stack([np.bincount(bucket, of_word[word, c], BUCKETS) for c in range(k)], 1), moved - expected]
        for x, g, s, q in zip((model.weights, model.moves), up, slope, square):
            g = g / total - RIDGE * x / 100
            s += 0.1 * (g - s)
            q += 0.01 * (g * g - q)
            x += RATE * (s / (1 - 0.9**i)) / (np.sqrt(q / (1 - 0.99**i)) + 1e-8)
    return model


def _bounded(text: str) -> Column:
    """The text, or of a longer one than LONGEST the same number of characters in stretches spread evenly from its start to its end."""
    size = LONGEST // PIECES
    part = lambda i: F.substring(F.col(text), (F.lit(1) + F.floor(i * (F.length(text) - size) / (PIECES - 1))).cast("int"), F.lit(size))
    return F.when(F.length(text) <= LONGEST, F.col(text)).otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), part)))


def fit(docs: DataFrame) -> Model:
    """The model of all languages of documents whose crc32 remainder isn't the held-out one. Without any, every text is `und`.

    Rows are drawn by a hash of doc_id and text, equal ones once; of each language the row with the least hash is drawn for certain."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of(docs).alias("text"))
    rows = rows.where("lang is not null").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30))
    # a row whose text has no word is the last choice
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(F.trim("text") == "", "draw")).alias("first")).select("lang", "n", F.col("first.draw").alias("least"))
    sizes = sizes.collect()  # a row a language, as many as the model has columns
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    share = docs.sparkSession.createDataFrame([(r["lang"], ROWS / r["n"], r["least"]) for r in sizes], "lang string, share double, least double")
    drawn = rows.join(F.broadcast(share), "lang").where("draw < share or draw = least")
    sample = drawn.select("doc_id", "lang", _bounded("text").alias("text")).dropDuplicates(["lang", "text"]).orderBy("doc_id", F.xxhash64("text"), "lang").select("text", "lang").toPandas()
    return train(sample["text"].tolist(), sample["lang"].tolist())


def label_words(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each row (one more), which words have letters, and each word's label probabilities."""
    edges, lettered, place, word, bucket = words_and_features(data, at)
    p = np.zeros((edges[-1], len(model.languages)))
    if edges[-1]:
        at_word, size = chains(edges, CHAIN)
        inside = np.arange(CHAIN) < size[:, None]
        p[at_word[inside]] = forward_backward(emissions(model, lettered, place, word, bucket)[at_word], size, model.moves)[0][inside]
    return edges, lettered, p


def _pieces(data: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows with their data in steps of bounded size; a long text comes in pieces that end at white space, where there is any."""
    for row in range(0, len(at) - 1):
        lo = int(at[row])
        while lo < at[row + 1]:
            hi = min(lo + most, int(at[row + 1]))
            if hi < at[row + 1]:
                blank = np.flatnonzero(data[lo:hi] <= 32)
                hi = lo + int(blank[-1]) + 1 if len(blank) else hi
            yield row, data[lo:hi], np.array([0, hi - lo])
            lo = hi


def has_letter(column: pa.Array) -> np.ndarray:
    """Which texts of a batch have a letter of any script."""
    at, data = utf8(column)
    plain = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128))])
    beyond = np.concatenate([[0], np.cumsum(data >= 128)])
    known = plain[at[1:]] > plain[at[:-1]]
    for i in np.flatnonzero(~known & (beyond[at[1:]] > beyond[at[:-1]])):  # only other scripts or signs: ask for a letter
        known[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return known


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch of bounded size."""
    k, rows = len(model.languages), len(column)
    if not k:
        return [UNKNOWN] * rows, np.zeros(rows)
    at, data = utf8(column)
    mass, words = np.zeros((rows, k)), np.zeros(rows)
    most = min(SLICE_BYTES, max(1 << 12, BLOCK * 4 // k))
    parts = [(slice(None), data, at)] if len(data) <= most else _pieces(data, at, most)
    for row, piece, own in parts:
        edges, lettered, p = label_words(model, piece, own)
        sums = np.concatenate([np.zeros((1, k)), np.cumsum(p * lettered[:, None], 0)])
        count = np.concatenate([[0], np.cumsum(lettered)])
        pick = 0 if isinstance(row, int) else slice(None)
        mass[row] += (sums[edges[1:]] - sums[edges[:-1]])[pick]
        words[row] += (count[edges[1:]] - count[edges[:-1]])[pick]
    known = has_letter(column)
    best = mass.argmax(1)
    score = np.where(known & (words > 0), mass[np.arange(rows), best] / np.maximum(words, 1), 0).clip(0, 1).round(9)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], score


def _predict(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1, SLICE_BYTES):
            names, score = predict(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def _keep(model, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text, SLICE_BYTES):
            column = batch.column(text)
            column = column.fill_null("") if column.null_count else column
            if model.value.languages:
                kept = [n != UNKNOWN for n in predict(model.value, column)[0]]
            else:
                kept = has_letter(column)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns as they are, whose text has a language; null, empty and letterless texts go. Of a model that learned none, the rows whose text has a letter."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")), docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row. A null text, or one without a letter, is `und` with score 0. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
