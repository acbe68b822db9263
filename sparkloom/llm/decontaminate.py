"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, units of measure and names (capitalised words, of any script with capitals) become typed placeholders; windows are also
formed with names left as words, for texts that write everything in capitals. Windows of WIDTH canonical words of
documents are hash-joined with those of the benchmark items, so a question with other parameters still meets its original. Matches are lined up by the
distance between the window's place in the document and in the item. Along one line, slot values of the item and of the document must stand for each other, one to one and within
their type; where they don't, the pairing that most windows of the line have holds, and windows with any other don't count.
A document is contaminated by an item of whose windows it has COVER or more on consistent lines, or of which it has RUN canonical words
in a row on one such line, whatever their share. Windows are also formed at the lengths of items shorter than WIDTH, which so are met inside longer documents.

A filter of bits set by the hashes of the benchmark's windows, BITS to a window up to MOST_BITS in all, keeps most windows that can't match from leaving the scan; it has
false positives only, and the join decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, SLICE_BYTES, Rolling, bit_filter, carried, materialise, own_columns, passes, small, stretch_hashes, text_of, utf8, words_of

WIDTH, COVER, RUN = 5, 0.5, 13
#: Bits of the filter for every window of the benchmark, and of all together: 2 MB.
BITS, MOST_BITS = 16, 1 << 24
#: Words that are units of measure.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz gram grams pound pounds ton tons ml l litre litres liter liters gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent "
    "kmh mph hz khz mhz ghz w kw mw v a kb mb gb tb degree degrees"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))


def _unit_hashes() -> np.ndarray:
    at, data = utf8(pa.array(UNITS))
    return np.unique(stretch_hashes(data, at[:-1], at[1:]))


_UNIT_HASHES = _unit_hashes()
_OUTER = np.isin(np.arange(256), np.frombuffer(b"!\"#'()*,./:;<=>?@[\\]^_`{|}~&-", np.uint8))


def _of_basic_plane() -> tuple[np.ndarray, np.ndarray]:
    """Each character's lower case, where that is one character of as many bytes, and whether it is a capital."""
    size = lambda c: 1 if c < 0x80 else 2 if c < 0x800 else 3
    lower, capital = np.arange(1 << 16), np.zeros(1 << 16, bool)
    for c in (*range(0xD800), *range(0xE000, 1 << 16)):
        x = chr(c).lower()
        if len(x) == 1 and size(ord(x)) == size(c):
            lower[c] = ord(x)
        capital[c] = chr(c).isupper() or chr(c).istitle()
    lower[ord("ς")] = ord("σ")  # a capital has no form for the end of a word
    return lower, capital


_LOWER, _CAPITAL = _of_basic_plane()


def _characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at these places of UTF-8; 0 beyond the basic plane."""
    a, b, c = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) if len(data) else np.zeros(0, np.int64) for i in range(3))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    return np.select([a < 0x80, (a >= 0xC2) & (a < 0xE0), (a >= 0xE0) & (a < 0xF0)], [a, two, three], 0)


def _lowered(data: np.ndarray) -> np.ndarray:
    """Capitals of the basic plane in lower case, in place."""
    out = data.copy()
    starts = np.flatnonzero(((data >= 65) & (data <= 90)) | ((data >= 0xC2) & (data < 0xF0)))
    was = _characters(data, starts)
    now = _LOWER[was]
    changed = now != was
    at, now = starts[changed], now[changed]
    one, two, three = now < 0x80, (now >= 0x80) & (now < 0x800), now >= 0x800
    out[at[one]] = now[one]
    out[at[two]], out[at[two] + 1] = 0xC0 | now[two] >> 6, 0x80 | now[two] & 63
    out[at[three]], out[at[three] + 1], out[at[three] + 2] = 0xE0 | now[three] >> 12, 0x80 | now[three] >> 6 & 63, 0x80 | now[three] & 63
    return out


def canonical(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of each canonical word without and with names as slots, whether it is a slot either way, its bytes' start and end, and the
    first of each row (one more). The hash of a slot is its type.

    What a word becomes depends on the word alone, wherever it stands; words of punctuation only are left out."""
    begins, ends, edges = words_of(data, at)
    inner = np.concatenate([[0], np.cumsum(~_OUTER[data])])
    some = inner[ends] > inner[begins]
    edges = np.concatenate([[0], np.cumsum(some)])[edges]
    begins, ends = begins[some], ends[some]
    solid = np.flatnonzero(~_OUTER[data])
    if len(begins):
        begins, ends = solid[np.searchsorted(solid, begins)], solid[np.searchsorted(solid, ends) - 1] + 1
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    numeric = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | np.isin(data, np.frombuffer(b".,+-/:%$", np.uint8)))])
    hashes = stretch_hashes(_lowered(data), begins, ends)
    is_number = (digit[ends] > digit[begins]) & (numeric[ends] - numeric[begins] == ends - begins)
    is_name = _CAPITAL[_characters(data, begins)]
    is_unit = np.isin(hashes, _UNIT_HASHES)
    plain = np.select([is_number, is_unit], [NUMBER, UNIT], hashes)
    is_slot = is_number | is_unit
    return plain, np.where(is_name & ~is_slot, NAME, plain), is_slot, is_slot | is_name, begins, ends, edges


def template_windows(data: np.ndarray, at: np.ndarray, bits: np.ndarray | None, widths: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Row, place, width, hash and slot values (behind their type) of the windows that have a word of their own, of those that pass the filter. Without
    widths, a text of fewer than WIDTH words is one window; else it has the windows of each of the widths. A window with names comes twice, with names as slots and as words in lower case."""
    plain, named, slot, named_slot, begins, ends, edges = canonical(data, at)
    n = np.diff(edges)
    rows, firsts, lasts = [], [], []
    for width in widths or [WIDTH]:
        many = np.maximum(n - width + 1, 0 if widths else (n > 0).astype(np.int64))
        rows.append(np.repeat(np.arange(len(n)), many))
        firsts.append(edges[rows[-1]] + np.arange(len(rows[-1])) - np.repeat(np.cumsum(many) - many, many))
        lasts.append(np.minimum(firsts[-1] + width, edges[rows[-1] + 1]))
    row, first, last = (np.concatenate(x) for x in (rows, firsts, lasts))
    raw = data.tobytes()
    found: list[tuple] = []
    names = np.concatenate([[0], np.cumsum(named_slot & ~slot)])
    for hashes, is_slot, some in ((plain, slot, None), (named, named_slot, names[last] > names[first])):
        key = Rolling(hashes)(first, last)
        slots = np.concatenate([[0], np.cumsum(is_slot)])
        keep = slots[last] - slots[first] < last - first
        if some is not None:
            keep &= some
        if bits is not None:
            keep &= passes(bits, key)
        values = [[f"{hashes[i]} {raw[begins[i] : ends[i]].decode('utf-8', 'replace')}" for i in range(a, b) if is_slot[i]] for a, b in zip(first[keep].tolist(), last[keep].tolist())]
        found.append((row[keep], (first - edges[row])[keep], (last - first)[keep], key[keep].view(np.int64), values))
    return (*(np.concatenate([x[i] for x in found]) for i in range(4)), found[0][4] + found[1][4])


def _emit(bits, widths: list[int] | None = None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2, SLICE_BYTES):
            at, data = utf8(batch.column(2))
            row, place, width, key, values = template_windows(data, at, bits.value if bits else None, widths)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(width), pa.array(key), pa.array(values, pa.list_(pa.string()))], ["id", "th", "place", "width", "key", "slots"])

    return run


_WINDOW = "id long, th long, place long, width long, key long, slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, th, items, cover) of the documents that an item contaminates: doc_id with null as NULL_ID, the text's 64-bit hash,
    the item_ids in order, and the highest share of such an item's windows.

    Null and empty texts have no windows; rows of a null item_id are left out. Repeated documents and items are judged once. Other columns are ignored."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), F.xxhash64(text_of(benchmark)).alias("th"), text_of(benchmark).alias("text"))
    asked = materialise(items.distinct().mapInArrow(_emit(None), _WINDOW), "templates")
    bits = bit_filter(asked, BITS, MOST_BITS)
    short = [r["width"] for r in asked.where(F.col("width") < WIDTH).select("width").distinct().collect()]  # WIDTH - 1 at most
    text = text_of(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = rows.mapInArrow(_emit(spark.sparkContext.broadcast(bits), [WIDTH, *sorted(short)]), _WINDOW).withColumnRenamed("width", "doc_width")
    sizes = asked.groupBy(F.col("id").alias("item_id"), F.col("th").alias("item_th")).agg(F.count_distinct("place").alias("windows"))
    of_item = asked.select(F.col("id").alias("item_id"), F.col("th").alias("item_th"), F.col("place").alias("item_place"), "width", "key", F.col("slots").alias("item_slots"))
    of_item = of_item.withColumn("nth", F.dense_rank().over(Window.partitionBy("item_id", "item_th").orderBy("item_place")))
    met = materialise(found.join(of_item, "key").where("doc_width = width").withColumn("line", F.col("place") - F.col("item_place")), "matches")
    line = ["id", "th", "item_id", "item_th", "line"]
    # how often each value of an item stands against each of the document along a line; its best partner and it must choose each other
    pairs = met.where(F.size("slots") > 0).select(*line, "item_place", "key", F.explode(F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y"))).alias("z")).select(*line, "item_place", "key", "z.*")
    votes = pairs.groupBy(*line, "x", "y").agg(F.count("*").alias("votes"))
    rank = lambda own, other: F.row_number().over(Window.partitionBy(*line, own).orderBy(F.desc("votes"), F.desc(F.col("x") == F.col("y")), other))
    torn = votes.select(*line, "x", "y", (rank("x", "y") + rank("y", "x") > 2).alias("torn")).where("torn").drop("torn")
    void = pairs.join(torn, [*line, "x", "y"]).select(*line, "item_place", "key").distinct()
    lined = materialise(met.join(void, [*line, "item_place", "key"], "left_anti").select(*line, "item_place", "nth").distinct(), "lines")
    covered = lined.groupBy(*line[:-1]).agg(F.count_distinct("item_place").alias("n")).join(sizes, ["item_id", "item_th"])
    # windows of slots only are in no table, so neighbours are those with nothing between them there
    ahead = F.row_number().over(Window.partitionBy(*line).orderBy("nth"))
    runs = lined.withColumn("run", F.col("nth") - ahead).groupBy(*line, "run").agg((F.max("item_place") - F.min("item_place") + WIDTH).alias("words"))
    longest = runs.groupBy(*line[:-1]).agg(F.max("words").alias("words"))
    hits = covered.join(longest, line[:-1]).withColumn("cover", F.col("n") / F.col("windows")).where((F.col("cover") >= COVER) | (F.col("words") >= RUN))
    return hits.groupBy("id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("cover").alias("cover"))


def flag(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of docs with contaminated, items (an empty list for a clean one) and cover, which replace columns of those names.

    Null and empty texts are clean, as is every text if the benchmark is empty. Rows that share a null doc_id are told apart by their text."""
    found = contaminated(docs, benchmark).withColumnsRenamed({"id": "_id", "th": "_th"})
    joined = carried(docs).join(found, ["_id", "_th"], "left")
    own = own_columns(docs, "contaminated", "items", "cover")
    return joined.select(*own, F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, all their columns as they are; null and empty texts stay."""
    found = contaminated(docs, benchmark).select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    return carried(docs).join(found, ["_id", "_th"], "left_anti").select(*own_columns(docs))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
