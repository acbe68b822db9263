"""Finding fixed-length windows that occur more than once, exactly and without shipping every position.

Each window of `window` symbols is filed under an anchor: the gram of `gram` symbols inside it with the least hash, the
leftmost of equals. The choice looks at nothing outside the window, so equal windows choose the same anchor at the
same offset, and neighbouring windows share theirs: a text has about 2 / (window - gram) anchors a symbol. Texts equal as a
whole are represented by one of them. Anchors that occur once in the corpus rule their windows out. The windows of
the others form one stretch of text per anchor. Equal stretches are summed up ahead of the shuffle, so a passage of many documents
travels once a task. The different stretches are dealt by their anchor, and an operator's own method compares them
there, each in the place of its least row (kd, th); what is found holds for all rows of that kd with an equal stretch, which a second
join tells. An anchor with more than `CROWD` different stretches (or MOST_BYTES of them) gets longer keys: its windows are split by their distance to the
anchor, `step` of them together, and filed under all that these have in common, window - step + 1 symbols. Windows that reach out
of a common passage then stand alone and are done with. Where even such a key has more than `LONG_CROWD` stretches, the windows go by
their own 128-bit hash, which counts with partial sums and joins back. So no task has to hold all stretches of an anchor.

Row identity is (kd, th): doc_id with null as the largest number, and the 64-bit hash of the text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, SLICE_BYTES, Rolling, materialise, mix, small, text_of, utf8

#: Different stretches of an anchor up to which they are compared in one task.
CROWD = 1024
#: The same for stretches that are filed under a longer key.
LONG_CROWD = 1 << 15
#: Bytes of stretches that a task compares at a time; a group may exceed it, up to MOST_BYTES. Beyond these it counts as crowded, too: words have no greatest length.
CHUNK, MOST_BYTES = 4_000_000, 1 << 26


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols. split: (data, offsets) -> symbols, first symbol of each row, byte start and end of each symbol."""

    window: int
    gram: int
    step: int
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]
    whole: Callable[[bytes], bytes]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, from running minima of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(edges: np.ndarray, window: int, most: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First and last symbol, first row, and row edges of pieces of bounded size; a long row comes in overlapping pieces."""
    lo, n = 0, len(edges) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, "right")) - 1))
        if hi == lo + 1:
            for c in range(int(edges[lo]), int(edges[hi]), most):
                stop = min(c + most + window - 1, int(edges[hi]))
                yield c, stop, lo, np.array([0, stop - c])
        else:
            yield int(edges[lo]), int(edges[hi]), lo, edges[lo : hi + 1] - edges[lo]
        lo = hi


def anchor_runs(symbols: np.ndarray, edges: np.ndarray, spec: Symbols) -> tuple[np.ndarray, ...]:
    """Row, first and last-but-one window start, anchor position (all within `symbols`) and anchor hash of each run."""
    found: list[tuple[np.ndarray, ...]] = []
    w, k = spec.window, spec.gram
    for lo, hi, row, own in _pieces(edges, w, SLICE_BYTES):
        n = hi - lo
        if n < w:
            continue
        at = np.arange(n - k + 1)
        hashes = Rolling(symbols[lo:hi])(at, at + k)
        low = np.uint64((1 << n.bit_length()) - 1)
        least = (sliding_min((hashes & ~low) | at.astype(np.uint64), w - k + 1) & low).astype(np.int64)
        crossing = np.zeros(n + 1, np.int32)
        np.add.at(crossing, np.maximum(own[1:] - w + 1, 0), 1)
        np.add.at(crossing, own[1:], -1)
        starts = np.flatnonzero(np.cumsum(crossing)[: n - w + 1] == 0)
        if not len(starts):
            continue
        anchors = least[starts]
        new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1] + 1
        found.append((row + np.searchsorted(own, first, "right") - 1, first + lo, last + lo, anchors[new] + lo, hashes[anchors[new]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _survey(spec: Symbols) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 3):
            at, data = utf8(batch.column(3))
            symbols, edges, _, _ = spec.split(data, at)
            rows, _, _, _, hashes = anchor_runs(symbols, edges, spec)
            order = np.lexsort((hashes, rows))  # the different anchors of each row, and how often it has each
            rows, hashes = rows[order], hashes[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])) if len(rows) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rows)))
            bounds = pa.array(np.searchsorted(rows[new], np.arange(batch.num_rows + 1)).astype(np.int32))
            raw = data.tobytes()
            whole = [spec.whole(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(edges)), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(hashes[new])), pa.ListArray.from_arrays(bounds, pa.array(times))],
                ["doc_id", "kd", "th", "n", "whole", "anchors", "times"],
            )

    return run


def _paired(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashes.view(np.uint64) ^ (rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _chosen(batch: pa.RecordBatch, column: int, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which runs have their anchor in the row's list."""
    wanted = batch.column(column)
    flat = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.isin(_paired(rows, hashes), _paired(owner, flat))


def _stretches(spec: Symbols) -> Callable:
    """kd, th, text, shared -> for each different stretch under a shared anchor of the row: anchor, digest, row, all its starts,
    number of windows, place of the anchor, and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2):
            at, data = utf8(batch.column(2))
            symbols, edges, begins, ends = spec.split(data, at)
            rows, first, last, anchor, hashes = anchor_runs(symbols, edges, spec)
            keep = _chosen(batch, 3, rows, hashes)
            rows, first, last, anchor, hashes = (x[keep] for x in (rows, first, last, anchor, hashes))
            stop = last + spec.window - 1
            a, b = (first, stop) if begins is None else (begins[first], ends[stop - 1] if len(stop) else stop)
            raw = data.tobytes()
            texts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
            own: dict[tuple[int, bytes], list[int]] = {}
            for i, (row, text) in enumerate(zip(rows.tolist(), texts)):
                own.setdefault((row, hashlib.blake2b(text, digest_size=16).digest()), []).append(i)
            lead = np.fromiter((x[0] for x in own.values()), np.int64, len(own))
            starts = [(first[x] - edges[rows[x[0]]]).tolist() for x in own.values()]
            take = pa.array(rows[lead])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[lead]), pa.array([k[1] for k in own], pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.list_(pa.int64()))]
                + [pa.array((last - first)[lead].astype(np.int32)), pa.array((anchor - first)[lead].astype(np.int32)), pa.array([texts[i] for i in lead.tolist()], pa.binary())],
                ["key", "digest", "kd", "th", "starts", "n", "p", "bytes"],
            )

    return run


def _split(spec: Symbols) -> Callable:
    """kd, th, s, n, p, bytes, kind of stretches -> the same of their parts, with the part's longer key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 5, SLICE_BYTES):
            at, data = utf8(batch.column(5))
            symbols, edges, begins, ends = spec.split(data, at)
            s, n, p = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 4))
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            part = (p[row] - within) // spec.step
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])) if len(row) else np.zeros(0, np.int64)
            row, first, part, count = row[new], within[new], part[new], np.diff(np.append(new, len(row)))
            common = edges[row] + p[row] - spec.step * part
            key = Rolling(symbols)(common, common - spec.step + 1 + spec.window, 7)
            a, b = edges[row] + first, edges[row] + first + count + spec.window - 1
            a, b = (a, b) if begins is None else (begins[a], ends[b - 1] if len(b) else b)
            raw, take = data.tobytes(), pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(s[row] + first), pa.array(count.astype(np.int32)), pa.array((p[row] - first).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()), batch.column(6).take(take)],
                ["key", "kd", "th", "s", "n", "p", "bytes", "kind"],
            )

    return run


def _windows(spec: Symbols) -> Callable:
    """kd, th, s, n, bytes, kind of stretches -> a row with a 128-bit hash for each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4, SLICE_BYTES):
            at, data = utf8(batch.column(4))
            symbols, edges, _, _ = spec.split(data, at)
            n = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = edges[row] + within
            one, two = Rolling(symbols)(start, start + spec.window, 1), Rolling(mix(symbols.astype(np.uint64)))(start, start + spec.window, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(batch.column(2).to_numpy(zero_copy_only=False)[row] + within), batch.column(5).take(take)], ["w1", "w2", "kd", "th", "s", "kind"])

    return run


def runs_of(row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first symbol and end of each run of neighbouring windows, given by row and start in order."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    last = start[np.concatenate([new[1:], [len(row)]]).astype(np.int64) - 1] if len(row) else start
    return row[new], start[new], last + window


def _by_group(compare: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable:
    """Stretches sorted by key, in chunks that end with a key -> covered symbol intervals."""

    def covered(chunk: pa.Table) -> pa.RecordBatch:
        row, first, end = compare(chunk)
        take, at = pa.array(row), chunk.column("s").to_numpy()[row]
        return pa.RecordBatch.from_arrays([chunk.column("kd").combine_chunks().take(take), chunk.column("th").combine_chunks().take(take), pa.array(at + first), pa.array(at + end), chunk.column("kind").combine_chunks().take(take)], ["kd", "th", "a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            begin, done = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), 0
            per_row = max(1, size // len(keys))
            for stop in begin[1:].tolist():
                if (stop - done) * per_row >= CHUNK or stop == begin[-1]:
                    yield covered(whole.slice(done, stop - done))
                    done = stop
            rest = whole.slice(done).combine_chunks()
            held = rest.to_batches()
            size = len(rest) * per_row
        if held:
            yield covered(pa.Table.from_batches(held).combine_chunks())

    return run


def repeated_windows(docs: DataFrame, spec: Symbols, compare: Callable, stretch_goes: str, window_goes: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The survey (doc_id, kd, th, n, whole; one row a document), the representatives (whole, kd, copies), and the
    texts of representatives with covered stretches (kd, th, text, spans of starts and size in symbols).

    compare: gets a table of stretches of some anchors and returns rows, and starts and ends within them, of what is covered.
    stretch_goes, window_goes: SQL over kd, copies and least_kd that tells whether an equal stretch or window elsewhere covers one."""
    doc_id = F.col("doc_id").cast("long")
    text = text_of(docs)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("kd"), F.xxhash64(text).alias("th"), text.alias("text"))
    survey = materialise(rows.mapInArrow(_survey(spec), "doc_id long, kd long, th long, n long, whole binary, anchors array<long>, times array<long>"), f"{name}-survey")
    first = materialise(survey.groupBy("whole").agg(F.min("kd").alias("kd"), F.count("*").alias("copies")), f"{name}-first")
    grams = survey.join(first, ["kd", "whole"]).select("kd", "th", F.explode(F.arrays_zip("anchors", "times")).alias("g")).select("kd", "th", F.col("g.anchors").alias("h"), F.col("g.times").alias("times"))
    shared = grams.groupBy("h").agg(F.sum("times").alias("times")).where("times > 1").select("h")
    wanted = grams.join(shared, "h").groupBy("kd", "th").agg(F.collect_set("h").alias("shared"))
    texts = rows.select("kd", "th", "text").join(wanted, ["kd", "th"]).dropDuplicates(["kd", "th"])
    texts = materialise(texts.select("kd", "th", "text", "shared"), f"{name}-texts")
    stretches = texts.mapInArrow(_stretches(spec), "key long, digest binary, kd long, th long, starts array<long>, n int, p int, bytes binary")
    lead = F.min(F.struct("kd", "th", F.col("starts")[0].alias("s")))
    kinds = stretches.groupBy("key", "digest").agg(lead.alias("lead"), F.sum(F.size("starts")).alias("copies"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("bytes").alias("bytes"))
    kinds = materialise(kinds.select("key", "digest", "lead.*", "copies", "n", "p", F.octet_length("bytes").cast("long").alias("size"), "bytes"), f"{name}-stretches")
    crowded = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("size").alias("size")).where((F.col("kinds") > CROWD) | (F.col("size") > MOST_BYTES)).select("key")
    # where an equal stretch doesn't cover the lead, its spans go to all members of its kd, by the digest
    partly = (F.col("copies") > 1) & ~F.expr(stretch_goes)
    kinds = kinds.withColumn("least_kd", F.col("kd")).withColumn("kind", F.when(partly, F.col("digest")))
    columns = ["key", "kd", "th", "s", "n", "p", "bytes", "kind"]
    parts = kinds.join(crowded, "key", "left_semi").select(*columns[1:]).mapInArrow(_split(spec), "key long, kd long, th long, s long, n int, p int, bytes binary, kind binary")
    parts = materialise(parts.withColumn("size", F.octet_length("bytes").cast("long")), f"{name}-parts")  # three steps read them
    sizes = parts.groupBy("key").agg(F.count("*").alias("stretches"), F.sum("size").alias("size")).where("stretches > 1")
    too_many = (F.col("stretches") > LONG_CROWD) | (F.col("size") > MOST_BYTES)
    few, many = (parts.join(sizes.where(x), "key", "left_semi") for x in (~too_many, too_many))
    near = kinds.join(crowded, "key", "left_anti").select(*columns).unionByName(few.select(*columns)).repartition(F.col("key")).sortWithinPartitions("key")
    near = near.mapInArrow(_by_group(compare), "kd long, th long, a long, b long, kind binary")
    windows = many.select("kd", "th", "s", "n", "bytes", "kind").mapInArrow(_windows(spec), "w1 long, w2 long, kd long, th long, s long, kind binary")
    counts = windows.groupBy("w1", "w2").agg(F.count("*").alias("copies"), F.min("kd").alias("least_kd")).where("copies > 1")
    far = windows.join(counts, ["w1", "w2"]).where(window_goes).select("kd", "th", F.col("s").alias("a"), (F.col("s") + spec.window).alias("b"), "kind")
    apart = materialise(near.union(far).select("kd", "th", "a", (F.col("b") - F.col("a")).alias("size"), "kind"), f"{name}-apart")
    inner = apart.where("kind is not null").groupBy(F.col("kind").alias("digest")).agg(F.collect_list(F.struct("a", "size")).alias("inner"))
    of_kind = kinds.where("copies > 1").select("digest", "least_kd", "copies", F.col("s").alias("lead_s")).join(inner, "digest", "left")
    members = stretches.select("digest", "kd", "th", "starts", "n").join(of_kind, "digest")
    all_of_it = F.array(F.struct(F.col("starts"), (F.col("n") + (spec.window - 1)).cast("long").alias("size")))
    some_of_it = F.transform("inner", lambda x: F.struct(F.transform("starts", lambda s: s + x["a"] - F.col("lead_s")).alias("starts"), x["size"].alias("size")))
    equal = members.select("kd", "th", F.explode(F.when(F.expr(stretch_goes), all_of_it).otherwise(some_of_it)).alias("x")).select("kd", "th", "x.starts", "x.size")
    apart = apart.where("kind is null").select("kd", "th", F.array("a").alias("starts"), "size")
    spans = apart.union(equal).groupBy("kd", "th").agg(F.collect_list(F.struct("starts", "size")).alias("spans"))
    return survey.drop("anchors", "times"), first, texts.select("kd", "th", "text").join(spans, ["kd", "th"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal runs of overlapping or touching stretches."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, a + x["size"]) for x in spans for a in x["starts"]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
