"""Document fingerprints by order MinHash, in DataFrame functions alone.

A text is a list of tokens, and its k-mers are pairs of neighbouring tokens. A token is a word of up to LONG characters; a longer run without white space, as of scripts
that don't part words, has a token of PART characters from each of its places on, so that one character more or less changes few of them. The
j-th occurrence of a k-mer counts as an element of its own. One hash deals the elements into BINS bins; a bin keeps the two elements
with the least hash, puts them in the order in which they stand in the text, and hashes that pair. So a
signature agrees only where the same rare elements come in the same order, which follows edit distance rather than the set of words alone.

All steps are array functions over one row: elements are packed as longs, hash above position, so that both sorts are of plain
numbers, and runs of equals are numbered from their first places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, text_of

BINS, LONG, PART = 32, 16, 8
_BLANK, _SIGN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: A short word whole or, in longer runs, each character with those that follow it.
_PIECE = rf"(?<!{_SIGN})({_SIGN}{{1,{LONG}}})(?!{_SIGN})|(?=({_SIGN}{{{PART}}})){_SIGN}"
#: Bits of the position in a packed element; an array has no place that needs more.
PLACE = 31
BIN_BITS = BINS.bit_length() - 1
HASH = 63 - PLACE
#: Documents of a range of doc_id within which next documents are found, and such ranges at most.
RANGE_ROWS, RANGES = 4096, 1 << 16


def _slice(values: Column, first: int, drop: int) -> Column:
    return F.slice(values, F.lit(first), F.greatest(F.size(values) - drop, F.lit(0)))


def _run_starts(values: str, shift: int) -> Column:
    """Places at which a sorted array of packed longs has a new value above `shift` bits."""
    ahead = F.concat(F.array(F.lit(-1).cast("long")), _slice(F.col(values), 1, 1))
    new = F.zip_with(F.col(values), ahead, lambda x, y: F.shiftright(x, shift) != F.shiftright(y, shift))
    return F.filter(F.transform(new, lambda is_new, i: F.when(is_new, i)), lambda i: i.isNotNull())


def _run_places(starts: str, size: Column) -> Column:
    """0, 1, 2, ... within each run."""
    ends = F.concat(_slice(F.col(starts), 2, 1), F.array(size))
    return F.flatten(F.zip_with(F.col(starts), ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))


def with_signature(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and `name`: an array of BINS longs, null where the text has no element in the bin; all of them for an empty text, which null is, too.

    Columns of df named _t, _k, _s, _o or _m are replaced on the way and mustn't be there."""
    place = (1 << PLACE) - 1
    other = [c for c in df.columns]
    parted = F.when(F.col(text).rlike(rf"{_SIGN}{{{LONG + 1}}}"), F.regexp_replace(text, _PIECE, "$1$2 ")).otherwise(F.col(text))
    df = df.select(*other, F.filter(F.split(parted, rf"{_BLANK}+"), lambda x: x != "").alias("_t"))
    kmers = F.when(F.size("_t") < 2, F.transform("_t", lambda x: F.xxhash64(x))).otherwise(F.zip_with(_slice(F.col("_t"), 1, 1), _slice(F.col("_t"), 2, 1), lambda x, y: F.xxhash64(x, y)))
    df = df.select(*other, F.sort_array(F.transform(kmers, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << HASH) - 1)), PLACE).bitwiseOR(i.cast("long")))).alias("_k"))
    df = df.select(*other, "_k", _run_starts("_k", PLACE).alias("_s"))
    df = df.select(*other, "_k", _run_places("_s", F.size("_k")).alias("_o"))
    numbered = F.zip_with("_k", "_o", lambda x, o: F.shiftleft(F.xxhash64(F.shiftright(x, PLACE), o).bitwiseAND(F.lit((1 << HASH) - 1)), PLACE).bitwiseOR(x.bitwiseAND(F.lit(place))))
    df = df.select(*other, F.sort_array(numbered).alias("_k"))
    in_bin = PLACE + HASH - BIN_BITS
    df = df.select(*other, "_k", _run_starts("_k", in_bin).alias("_s"))
    df = df.select(*other, "_k", _run_places("_s", F.size("_k")).alias("_o"))
    df = df.select(*other, F.filter(F.zip_with("_k", "_o", lambda x, o: F.when(o < 2, x)), lambda x: x.isNotNull()).alias("_k"))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, in_bin)

    def hashed(x: Column) -> Column:
        return F.shiftright(x, PLACE)

    def place_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(place))

    none = F.array(F.lit(-1).cast("long"))
    near = F.arrays_zip(F.col("_k").alias("x"), F.concat(none, _slice(F.col("_k"), 1, 1)).alias("before"), F.concat(_slice(F.col("_k"), 2, 1), none).alias("after"))

    def pair(z: Column) -> Column:
        x, y = z["x"], z["after"]
        both = F.when(place_of(x) < place_of(y), F.xxhash64(hashed(x), hashed(y))).otherwise(F.xxhash64(hashed(y), hashed(x)))
        one = F.xxhash64(hashed(x))
        return F.struct(bin_of(x).cast("int").alias("key"), F.when(bin_of(y) == bin_of(x), both).otherwise(one).bitwiseAND(F.lit(0xFFFFFFFF)).alias("value"))

    df = df.select(*other, F.map_from_entries(F.transform(F.filter(near, lambda z: bin_of(z["x"]) != bin_of(z["before"])), pair)).alias("_m"))
    return df.select(*other, F.array(*[F.element_at("_m", F.lit(i)) for i in range(BINS)]).alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of bins in use by either text in which both have the same pair; 1 for two texts without elements."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y)))
    used, equal = F.size(F.filter(same, lambda v: v.isNotNull())), F.size(F.filter(same, lambda v: v))
    return F.when(used == 0, F.lit(1.0)).otherwise(equal / F.greatest(used, F.lit(1)))


def as_text(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.coalesce(F.lower(F.lpad(F.hex(v), 8, "0")), F.lit("-" * 8))), "")


def _ranges(ids: DataFrame) -> tuple[list[int], int | None]:
    """Lower ends of the second and later ranges of keys, all of them keys that occur, and the least key."""
    seen = ids.agg(F.count("*").alias("n"), F.min("key").alias("least")).first()
    parts = min(RANGES, -(-seen["n"] // RANGE_ROWS))
    if parts < 2:
        return [], seen["least"]
    cuts = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("cuts")).first()["cuts"]
    return sorted(set(cuts) - {seen["least"]}), seen["least"]


def _range_of(cuts: list[int]) -> Column:
    """Number of cuts up to the key, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    key = F.col("key")
    coarse = F.size(F.filter(F.array(*[F.lit(p[0]).cast("long") for p in parts]), lambda c: c <= key))
    tails = F.array(*[F.array(*[F.lit(c).cast("long") for c in p[1:]]).cast("array<bigint>") for p in parts])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + 1 + F.size(F.filter(F.get(tails, F.greatest(coarse - 1, F.lit(0))), lambda c: c <= key)))


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, and the signatures of the text, its edited text and the next document's text, for every row.

    Documents stand in order of doc_id, null last, then of text, so repeated rows follow each other; the first follows the last. Null texts are empty.
    An empty text has no element and an edited text without one too. Other columns are ignored. An empty table gives no rows.

    Texts are shuffled once, by ranges of doc_id; the first document of a range is also sent to the range below."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("key"), text_of(docs).alias("text"))
    cuts, least = _ranges(rows.select("key"))
    signed = with_signature(rows.withColumn("own", _range_of(cuts)), "text", "signature")
    own = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    # the guest of a range is the least document of the next one; the last range has the first of all documents
    is_cut = F.get(F.array(F.lit(None), *[F.lit(c) for c in cuts]).cast("array<bigint>"), F.col("own")) == F.col("key")
    below = F.when(is_cut, F.struct((F.col("own") - 1).alias("range"), F.lit(True).alias("guest"))).when(F.col("key") == F.lit(least).cast("long"), F.struct(F.lit(len(cuts)).alias("range"), F.lit(True).alias("guest")))
    dealt = signed.select("*", F.explode(F.filter(F.array(own, below), lambda x: x.isNotNull())).alias("at")).select("*", "at.range", "at.guest")
    order = Window.partitionBy("range").orderBy("guest", "key", "text")
    pairs = dealt.select("doc_id", "text", "signature", "guest", F.length("text").cast("long").alias("n_chars"), F.lead("text").over(order).alias("next_text"), F.lead("signature").over(order).alias("next_signature")).where(~F.col("guest"))
    cut = F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int")))
    return with_signature(pairs.select("doc_id", "n_chars", "signature", "next_signature", edited.alias("edited")), "edited", "edited_signature")


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    found = fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("signature").alias("fingerprint"),
        as_text("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
