"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models of lower-cased words, of toxic and of ordinary documents, are counted over all labelled training rows by Spark aggregates; every word and
every pair counts, and the tables grow with the corpus. Absolute discounts set probability aside, at every level as much for either class, so that a class of
fewer texts doesn't give rare expressions more. Pairs back off to their class's single words, these to what the classes share: in how many different contexts a word was met in
either class. What was met fewer than RARE times in all is discounted whole: it has no entry and is as likely under both. So only what was met often in one class
tells them apart. Pairs that say no more than their words (a log ratio nearer to theirs than CLOSE) are left to them.

Tasks count what blocks of about BLOCK bytes hold and deal it out by word, packed: a part's different words once and its pairs as numbers of them, so a pair costs a few
bytes. Parts are summed up; pairs below RARE leave only how many contexts they give their words.

What a word or pair says under the models is one number, so the models come down to a table of keys and log ratios. The MOST_HELD most frequent entries at most
are held by every task. While these are all, texts are scored where they are read. Beyond, no task holds the table whole: texts are read once into blocks, documents as numbers of
their block's words; what a block asks for of the other entries is joined with their table and comes back to the block, where its documents are scored. A filter of MOST_BITS bits
at most keeps most words and pairs without an entry from being asked for; it has false positives only, and the join decides. Results are the same either way. Labels
are held by tasks likewise, up to MOST_LABELS, and joined beyond.

Log-likelihood ratios are normalised by length, once over the whole text and once over each stretch of SEGMENT words, of which the HIGHEST highest count; a logistic
curve, fitted on about CURVE_ROWS training rows that were left out of the counts, turns the two into a score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SLICE_BYTES, bit_filter, crc_mod, materialise, mix, passes, small, stretch_hashes, text_of, utf8, words_of
from sparkloom.session import discard, written

SEGMENT, HIGHEST, DISCOUNT, RARE, CLOSE = 2, 2, 0.75, 5, 0.1
BLOCK, BITS, MOST_BITS = 12_000_000, 16, 1 << 25
#: Entries (16 bytes each) and labels (9 bytes) that a task holds at most; tables have the rest.
MOST_HELD, MOST_LABELS = 1 << 21, 1 << 23
#: Parts among which the contexts of a word are dealt out, so that a frequent word doesn't fill one.
SPREAD = 16
#: Rows by which the logistic curve is fitted, about; drawn by a hash of doc_id and text.
CURVE_ROWS = 20_000
FOLDS, CURVE_FOLD, HELD_OUT = 5, 4, 0
Held = tuple[np.ndarray, np.ndarray]  # sorted keys, and what each has: a log ratio, or a label
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, A-Z in lower case, and the first word of each row (one more)."""
    at, data = utf8(column)
    data = LOWER[data]
    begins, ends, edges = words_of(data, at)
    return stretch_hashes(data, begins, ends), edges


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def pair_keys(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word with the one before it in the row, and which words have one."""
    ahead = np.concatenate([words[:1], words[:-1]])
    has = np.ones(len(words), bool)
    has[edges[:-1][edges[:-1] < len(words)]] = False
    return pair_key(ahead, words), has


def pack(x: np.ndarray) -> bytes:
    """An array as zstd of its byte planes, after its length in bytes."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _labelled(batches: Iterator[pa.RecordBatch], labels: Held) -> Iterator[pa.RecordBatch]:
    """doc_id and more -> those with a label, and toxic."""
    ids, toxic = labels
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(ids, own).clip(0, max(len(ids) - 1, 0))
        hit = np.flatnonzero(ids[place] == own) if len(ids) else np.zeros(0, np.int64)
        taken = batch.take(pa.array(hit))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(toxic[place[hit]].astype(np.int32))], [*batch.schema.names, "toxic"])


def _count(parts: int, labels=None) -> Callable:
    """doc_id, text, and toxic if no labels are held -> for each part what a block has of it: words and the pairs between them (numbers of a and, in steps, of b, then counts in ordinary and toxic
    texts), and single words with four counts: in ordinary and toxic texts, and of these before another word."""

    def tally(place: np.ndarray, toxic: np.ndarray, n: int) -> list[np.ndarray]:
        bad = np.bincount(place, toxic, n).astype(np.uint32)
        return [np.bincount(place, minlength=n).astype(np.uint32) - bad, bad]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches if labels is None else _labelled(batches, labels.value), 1, BLOCK):
            hashes, edges = word_hashes(batch.column(1))
            if not len(hashes):
                continue
            toxic = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(edges))
            words, place = np.unique(hashes, return_inverse=True)
            _, has = pair_keys(hashes, edges)
            second = np.flatnonzero(has)
            counts = [*tally(place, toxic, len(words)), *tally(place[second - 1], toxic[second], len(words))]
            pair, at = np.unique(place[second] * len(words) + place[second - 1], return_inverse=True)  # by b, then a
            a, b = pair % len(words), pair // len(words)
            both = tally(at, toxic[second], len(pair))
            with np.errstate(over="ignore"):
                of_pair = mix(words[b] + (words[a] & np.uint64(SPREAD - 1))) % np.uint64(parts)
            of_word = words % np.uint64(parts)
            by_pair, by_word = np.argsort(of_pair, kind="stable"), np.argsort(of_word, kind="stable")
            cut_pair, cut_word = (np.searchsorted(x[o], np.arange(parts + 1, dtype=np.uint64)) for x, o in ((of_pair, by_pair), (of_word, by_word)))
            rows = []
            for i in range(parts):
                p, w = by_pair[cut_pair[i] : cut_pair[i + 1]], by_word[cut_word[i] : cut_word[i + 1]]
                if len(p) + len(w):
                    used, number = np.unique(np.concatenate([a[p], b[p]]), return_inverse=True)
                    numbers = [number[: len(p)], np.diff(number[len(p) :], prepend=0), *[x[p] for x in both]]
                    rows.append((i, pack(words[used]), pack(np.concatenate(numbers).astype(np.uint32)), pack(words[w]), pack(np.concatenate([x[w] for x in counts]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], ["part", "words", "pairs", "singles", "counts"])

    return run


def _sums(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first row of each key, and the sums over its rows."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return order, [x.astype(np.int64) for x in counts]
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    return order[first], [np.add.reduceat(x[order].astype(np.int64), first) for x in counts]


COUNTS = "key long, a long, b long, c0 long, c1 long, lead0 long, lead1 long, contexts long"


def _sum_part(part: pa.Table) -> pa.Table:
    """What the blocks have of a part -> pairs met RARE times or more (key, a, b, c0, c1), words (key, c0, c1, lead0, lead1), and the contexts of words in pairs here (key, contexts)."""
    rows = part.select(["words", "pairs", "singles", "counts"]).to_pydict()
    a, b, both = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.uint32)]
    for words, pairs in zip(rows["words"], rows["pairs"]):
        words, pairs = unpack(words, np.uint64), unpack(pairs, np.uint32).reshape(4, -1)
        a.append(words[pairs[0]])
        b.append(words[np.cumsum(pairs[1], dtype=np.int64)])
        both.append(pairs[2:])
    a, b, both = np.concatenate(a), np.concatenate(b), np.hstack(both)
    key = pair_key(a, b)
    first, sums = _sums(key, list(both))
    second, contexts = np.unique(b[first], return_counts=True)
    often = sums[0] + sums[1] >= RARE
    of_pairs = [x[first[often]].view(np.int64) for x in (key, a, b)] + [x[often] for x in sums]
    words = np.concatenate([np.zeros(0, np.uint64), *[unpack(x, np.uint64) for x in rows["singles"]]])
    first, sums = _sums(words, list(np.hstack([np.zeros((4, 0), np.uint32), *[unpack(x, np.uint32).reshape(4, -1) for x in rows["counts"]]])))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    made = [dict(zip(names, of_pairs)), dict(zip(["key", "c0", "c1", "lead0", "lead1"], [words[first].view(np.int64), *sums])), {"key": second.view(np.int64), "contexts": contexts}]
    return pa.concat_tables([pa.table([pa.array(x[n], pa.int64()) if n in x else pa.nulls(len(x["key"]), pa.int64()) for n in names], names) for x in made])


def _discounted(c: str) -> Column:
    return F.when(F.col("c0") + F.col("c1") >= RARE, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).otherwise(0.0)


def model_entries(counts: DataFrame) -> DataFrame:
    """Both models in one table: for a word (key, ratio: the logarithm of how much likelier it is in toxic texts, n: how often it was met), and the same for a pair
    that tells more than its words."""
    own = [_discounted(c).alias(d) for c, d in (("c0", "d0"), ("c1", "d1"))]
    pairs = counts.where("a is not null").select("key", "a", "b", "c0", "c1", *own)
    every = counts.where("a is null").groupBy(F.col("key").alias("w")).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c0", "c1", "lead0", "lead1", "contexts")])
    every = every.select("w", "c0", "c1", "lead0", "lead1", *own, (F.col("contexts") + 0.5).alias("contexts"))
    every = materialise(every, "toxicity-words")
    # a context leaves to single words what the class that knows less of it does
    kept = pairs.groupBy(F.col("a").alias("w")).agg(F.sum("d0").alias("sum_d0"), F.sum("d1").alias("sum_d1"))
    left = [F.when(F.col(f"lead{c}") > 0, 1 - F.col(f"sum_d{c}") / F.col(f"lead{c}")).otherwise(1.0) for c in (0, 1)]
    leads = every.join(kept, "w").select(F.col("w").alias("a"), "sum_d0", "sum_d1", F.greatest(*left).alias("z")).where("z < 1")
    known = F.col("c0") + F.col("c1") >= RARE
    s = every.agg(F.sum("contexts"), F.sum("d0"), F.sum("d1"), F.sum(F.when(known, F.lit(DISCOUNT)).otherwise(0.0)), F.sum(F.col("c0") + F.col("c1"))).first()
    contexts, sum0, sum1, aside, every_word = (float(x or 0) for x in s)
    back = aside / max(every_word, 1)
    p = [(1 - back) * F.col(d) / max(total, 1e-9) + back * F.col("contexts") / max(contexts, 1) for d, total in (("d0", sum0), ("d1", sum1))]
    single = every.where(known).select(F.col("w").alias("key"), p[0].alias("p0"), p[1].alias("p1"), (F.col("c0") + F.col("c1")).alias("n"))
    q = [(1 - F.col("z")) * F.col(f"d{c}") / F.col(f"sum_d{c}") for c in (0, 1)]
    seen = pairs.where("d0 > 0 or d1 > 0").join(leads, "a").select("key", "b", "z", q[0].alias("x"), q[1].alias("y"), (F.col("c0") + F.col("c1")).alias("n"))
    seen = seen.join(single.select(F.col("key").alias("b"), "p0", "p1"), "b")
    alone, both = F.log(F.col("p1") / F.col("p0")), F.log((F.col("y") + F.col("z") * F.col("p1")) / (F.col("x") + F.col("z") * F.col("p0")))
    telling = seen.where(F.abs(both - alone) >= CLOSE).select("key", both.alias("ratio"), "n")
    return single.select("key", alone.alias("ratio"), "n").unionByName(telling)


@dataclass
class Model:
    held: Held  # the most frequent entries
    rest: DataFrame | None  # key, ratio of the others, if there are any
    bits: np.ndarray  # a filter of the keys of these
    curve: np.ndarray  # weights of the two ratios, and the offset


def _model(entries: DataFrame) -> Model:
    """Entries are held from that frequency on from which they are MOST_HELD at most, in steps of a sixteenth of an octave."""
    step = F.floor(F.log2("n") * 16)
    held, least = 0, 0
    for r in entries.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > MOST_HELD:
            least = r["step"] + 1
            break
    own = entries.where(step >= least).select("key", "ratio").toArrow()  # rows would take the driver a hundred bytes each
    keys = own["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    rest = entries.where(step < least).select("key", "ratio") if held > MOST_HELD else None
    return Model((keys[order], own["ratio"].to_numpy()[order]), rest, np.zeros(1, np.uint64) if rest is None else bit_filter(rest, BITS, MOST_BITS), np.zeros(3))


def look_up(tables: list[Held], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log ratio of each key, 0 without an entry, and which have one. wanted: ascending, which is kind to caches."""
    ratio, found = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    for keys, values in tables:
        if len(keys):
            place = np.searchsorted(keys, wanted).clip(0, len(keys) - 1)
            hit = keys[place] == wanted
            ratio[hit], found = values[place[hit]], found | hit
    return ratio, found


def _blocks(bits, held, labels) -> Callable:
    """doc_id, draw, text -> rows of documents (block, doc_id, draw, codes) and of blocks (block, words in order of codes, words and pairs that aren't held and pass the filter).
    Words that can't have an entry are all word 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in small(batches if labels is None else _labelled(batches, labels.value), 2, BLOCK):
            block += 1
            hashes, edges = word_hashes(batch.column(2))
            words, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
            here = look_up([held.value], words)[1]
            maybe = ~here & passes(bits.value, words)
            live = here | maybe
            order = np.argsort(-times * live, kind="stable")[: live.sum()]  # frequent words have small numbers, which pack well
            code = np.zeros(len(words), np.uint32)
            code[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
            codes = code[place].view(np.uint8).reshape(-1, 4)
            packed = [codes[a:b].T.tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            keys, has = pair_keys(hashes, edges)
            has &= live[place] & np.concatenate([[False], live[place][:-1]])[: len(place)]  # a pair with an entry has words with one
            keys = np.unique(keys[has])
            keys = keys[passes(bits.value, keys) & ~look_up([held.value], keys)[1]]
            n = batch.num_rows
            lists = [pa.array([None] * n + [x.view(np.int64)], pa.list_(pa.int64())) for x in (words[order], np.concatenate([words[maybe], keys]))]
            ids = [pa.concat_arrays([batch.column(i), pa.nulls(1, pa.int64())]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, block)), *ids, pa.array([*packed, None], pa.binary()), *lists], ["block", "doc_id", "draw", "codes", "words", "asked"])

    return run


def ratios_of(words: np.ndarray, edges: np.ndarray, tables: list[Held]) -> np.ndarray:
    """Rows of (mean log ratio of the highest stretches, mean log ratio of the text), 0 for a text without words."""
    every, place = np.unique(words, return_inverse=True)
    single, known = look_up(tables, every)
    ratio, known = single[place], known[place]
    pair, has = pair_keys(words, edges)
    has &= known & np.concatenate([[False], known[:-1]])[: len(known)]  # a pair with an entry has words with one
    pair, place = np.unique(pair[has], return_inverse=True)
    own, found = look_up(tables, pair)
    ratio[has] = np.where(found[place], own[place], ratio[has])
    n = np.diff(edges)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    out = np.zeros((len(n), 2))
    out[:, 1] = (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(n, 1)
    parts = -(-n // SEGMENT)
    row = np.repeat(np.arange(len(n)), parts)
    first = edges[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.minimum(first + SEGMENT, edges[row + 1])
    value = (sums[last] - sums[first]) / (last - first)
    order = np.lexsort((-value, row))  # of every text the highest stretches first
    high = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts) < HIGHEST
    out[:, 0] = np.bincount(row[high], value[order][high], len(n)) / HIGHEST
    return out.round(9)  # sums over a block differ in their last bits by where a text stands in it


def _score_texts(held, labels) -> Callable:
    """doc_id, draw, text -> doc_id, draw, and the two ratios, where the held entries are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches if labels is None else _labelled(batches, labels.value), 2, min(BLOCK, SLICE_BYTES)):  # larger ones would share no more
            r = ratios_of(*word_hashes(batch.column(2)), [held.value])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r[:, 0]), pa.array(r[:, 1])], ["doc_id", "draw", "top", "mean"])

    return run


def _score_block(held) -> Callable:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        codes = block.column("codes").to_pylist()
        words = next(x for x in block.column("words") if x.is_valid).values.to_numpy(zero_copy_only=False).view(np.uint64)
        words = np.concatenate([np.setdiff1d(np.arange(len(words) + 1, dtype=np.uint64), words)[:1], words])  # word 0: no other
        docs = [i for i, x in enumerate(codes) if x is not None]
        own = [np.frombuffer(codes[i], np.uint8).reshape(4, -1).T for i in docs]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        keys = answers.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        tables = [held.value, (keys[order], answers.column("ratio").to_numpy()[order])]
        r = np.zeros((len(docs), 2))
        lo = 0
        while lo < len(docs):  # a few megabytes of words at a time
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + (1 << 19), "right")) - 1)
            at = np.concatenate([*own[lo:hi], np.zeros((0, 4), np.uint8)])
            r[lo:hi] = ratios_of(words[np.ascontiguousarray(at).view(np.uint32).ravel()], edges[lo : hi + 1] - edges[lo], tables)
            lo = hi
        take = pa.array(docs, pa.int64())
        return pa.table({"doc_id": block.column("doc_id").take(take), "draw": block.column("draw").take(take), "top": r[:, 0], "mean": r[:, 1]})

    return run


def ratios(docs: DataFrame, model: Model, share: float = 1.0, labels=None) -> DataFrame:
    """doc_id, draw (64-bit hash of doc_id and text), and the two normalised log ratios, for every row, or for a share of those that have a label."""
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("draw"), text.alias("text"))
    rows = rows.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30)) if share < 1 else rows
    send = docs.sparkSession.sparkContext.broadcast
    held = send(model.held)
    if model.rest is None:
        return rows.mapInArrow(_score_texts(held, labels), "doc_id long, draw long, top double, mean double")
    blocks = rows.mapInArrow(_blocks(send(model.bits), held, labels), "block long, doc_id long, draw long, codes binary, words array<long>, asked array<long>")
    blocks = materialise(blocks, "toxicity-blocks")
    asked = blocks.where("asked is not null").select(F.col("block").alias("asker"), F.explode("asked").alias("key"))
    answers = asked.join(model.rest, "key").select("asker", "key", "ratio")
    return blocks.drop("asked").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_score_block(held), "doc_id long, draw long, top double, mean double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and offset by Newton steps, with a ridge on all but the offset."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    pull = ridge * np.eye(len(w))
    pull[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows whose crc32 remainder isn't the held-out one. Labels by a null doc_id or of null toxic are
    ignored; of several labels of a doc_id the highest holds. Without any label, every score is 0.5."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic is not null").withColumn("fold", crc_mod("doc_id", FOLDS)).where(F.col("fold") != HELD_OUT)
    own = own.groupBy("doc_id", "fold").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fold = crc_mod("doc_id", FOLDS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).where(F.col("doc_id").isNotNull() & (fold != HELD_OUT))
    before, spark = written(), docs.sparkSession
    if own.count() <= MOST_LABELS:  # texts stay where they are read
        held = own.select("doc_id", F.col("toxic").cast("byte").alias("toxic")).toArrow().sort_by("doc_id")
        held = spark.sparkContext.broadcast((held["doc_id"].to_numpy(), held["toxic"].to_numpy()))
        rows = texts
    else:
        held, rows = None, materialise(texts.join(own.select("doc_id", "toxic"), "doc_id"), "toxicity-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(fold != CURVE_FOLD).mapInArrow(_count(parts, held), "part int, words binary, pairs binary, singles binary, counts binary")
    counts = materialise(counted.groupBy("part").applyInArrow(_sum_part, COUNTS), "toxicity-counts")
    entries = materialise(model_entries(counts), "toxicity-entries")
    model = _model(entries)
    share = CURVE_ROWS / max(texts.where(fold == CURVE_FOLD).select("doc_id").join(own, "doc_id").count(), 1)
    found = ratios(rows.where(fold == CURVE_FOLD), model, share, held).dropDuplicates(["doc_id", "draw"]).join(own, "doc_id").orderBy("doc_id", "draw")
    seen = found.select("toxic", "top", "mean").toPandas().to_numpy(float).reshape(-1, 3)
    discard(spark, before, keep="" if model.rest is None else "toxicity-entries")
    model.curve = logistic(seen[:, 1:], seen[:, 0]) if len(seen) else np.zeros(3)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the two normalised log ratios, for every row; null and wordless texts have ratios of 0. Other columns are ignored; an empty table gives no rows."""
    w = [F.lit(float(x)) for x in model.curve]
    line = F.least(F.greatest(F.col("top") * w[0] + F.col("mean") * w[1] + w[2], F.lit(-35.0)), F.lit(35.0))
    return ratios(docs, model).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"), "top", "mean")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
