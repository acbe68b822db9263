"""SimHash near-dedup over a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. Their Manhattan distance never exceeds
the Hamming distance, so fingerprints within `DISTANCE` bits lie within that range on the grid of counts, and
differ in at most `DISTANCE` of `GROUPS` groups of segments. The range join therefore meets them in a grid
cell of the remaining groups; Manhattan distance and then Hamming distance decide each meeting. Counts are held
in unary (0, 1, 11), which makes their Manhattan distance the bit count of an exclusive or.

A cell with more than `CELL` different fingerprints isn't paired up: its members are linked exactly through the 65
points within one bit of each of them, as two fingerprints differ in at most two bits just when they share
such a point. A point has at most 65 fingerprints, so no group grows with the data.

`similar_documents` finds texts by the Jaccard likeness of their shingle sets, for which one fingerprint of 64 bits is too coarse: at a likeness of 0.8 two
fingerprints differ in about ten bits, and no cell of so few common segments tells texts apart. So each text also has SAMPLES fingerprints of TAKEN shingles each,
drawn by hashes that all texts share; their segment counts are its cells of the grid. Of what meets there, sizes, the Manhattan and then the Hamming distance of the whole
texts' fingerprints (RANGE) rule out most. In crowds a second embedding does, too: whether a set has an odd number of shingles in each of PARTS parts. Every shingle that only
one of two sets has changes one of those bits, so their distance never exceeds the number of such shingles. What is left is decided by the shingle sets themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Rolling, bit_filter, materialise, mix, passes, small, stretch_hashes, text_of, utf8, words_of
from sparkloom.llm.components import connected_components

SHINGLE, SEED, DISTANCE, GROUPS, CELL = 3, 42, 2, 5, 64
#: Shingles that are hashed and counted at a time.
BLOCK = 1 << 16
ODD = 0x5555555555555555
#: Shingle size and likeness of `similar_documents`.
WORDS, SIMILARITY = 5, 0.8
#: Two texts of likeness j share a sample with probability 1 - (1 - j**TAKEN)**SAMPLES: 0.998 at 0.8, 0.9999 at 0.85.
SAMPLES, TAKEN = 20, 6
#: Bits in which the fingerprints of similar texts may differ. At a likeness of 0.8 ten are expected, with a deviation of three.
RANGE = 24
PARTS = 1024
#: Bits of the filter of doc_ids whose sets are wanted, for each of them and in all: 4 MB.
BITS, MOST_BITS = 16, 1 << 25


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the three-word shingles of a text; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        part = words[lo : min(lo + BLOCK, n) + SHINGLE - 1]
        shingles = [b"%b %b %b" % x for x in zip(part, part[1:], part[2:])] if len(words) >= SHINGLE else [b" ".join(part)]
        hashes = np.fromiter([digest(s, SEED) for s in shingles], np.uint64, len(shingles))
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = utf8(batch.column(1))
        raw = data.tobytes()
        found = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed long) for every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _counts(fp: str) -> Column:
    """Bit counts of the two-bit segments, each in unary."""
    low, high = F.col(fp).bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _masks() -> list[int]:
    """The segments kept by each choice of GROUPS - DISTANCE groups, as signed masks."""
    group = [sum(3 << 2 * s for s in range(32) if s % GROUPS == g) for g in range(GROUPS)]
    kept = [sum(x) for x in combinations(group, GROUPS - DISTANCE)]
    return [m - 2**64 if m >= 2**63 else m for m in kept]


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints of `distinct` (fp) within DISTANCE bits, directly or through a third."""
    points = distinct.select("fp", _counts("fp").alias("counts"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(_masks())])).alias("k")
    keyed = points.select("fp", "counts", cells).select("fp", "counts", "k.choice", "k.cell")
    shared = keyed.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(keyed.join(shared, ["choice", "cell"]), "cells")
    a, b = met.where(f"n <= {CELL}").alias("a"), met.where(f"n <= {CELL}").alias("b")
    near = (
        a.join(b, ["choice", "cell"])
        .where("a.fp < b.fp")
        .where(F.bit_count(F.col("a.counts").bitwiseXOR(F.col("b.counts"))) <= DISTANCE)
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= DISTANCE)
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )
    crowded = met.where(f"n > {CELL}").select("fp").distinct()
    flips = [0] + [1 << i if i < 63 else -(2**63) for i in range(64)]
    shared_points = (
        crowded.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("point"))
        .groupBy("point")
        .agg(F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
        .where("a <> b")
    )
    return near.union(shared_points).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links of at most DISTANCE bits) for every row of docs.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows give repeated rows. A null
    doc_id stays null and counts for no component; a component of such rows alone has a null component_id.
    Other columns of docs are ignored. An empty table gives no rows."""
    rows = materialise(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(classes.select("fp")), "a", "b")
    rooted = materialise(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ends = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(ends, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of `size` words of texts, A-Z in lower case, and the first of each row (one more). Fewer words are one shingle."""
    at, data = utf8(column)
    upper = (data >= 65) & (data <= 90)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    begins, ends, edges = words_of(data, at)
    words, n = stretch_hashes(data, begins, ends), np.diff(edges)
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), many)
    first = edges[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return Rolling(words)(first, np.minimum(first + size, edges[row + 1])), np.concatenate([[0], np.cumsum(many)])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash over the last axis."""
    bits = np.unpackbits(hashes.astype(">u8")[..., None].view(np.uint8), axis=-1)
    return np.packbits(2 * bits.sum(-2, dtype=np.int32) > hashes.shape[-1], axis=-1).view(">u8")[..., 0].astype(np.uint64)


def _sketch(size: int) -> Callable:
    """doc_id, text -> doc_id, digest of the shingle set, its size, fingerprint, the sample fingerprints, and the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = mix(np.arange(1, 2 * SAMPLES * TAKEN + 1, dtype=np.uint64)).reshape(2, -1)
        draw[0] |= np.uint64(1)
        for batch in small(batches, 1):
            hashes, edges = shingle_hashes(batch.column(1), size)
            digests, n, fps = [], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            odd = np.zeros((batch.num_rows, PARTS), np.uint8)
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                own = np.unique(hashes[a:b])
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                n[i] = len(own)
                odd[i] = np.bincount((own >> np.uint64(32) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
                ones = np.zeros(64, np.int64)
                for lo in range(0, len(own), BLOCK):
                    ones += np.unpackbits(own[lo : lo + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
                fps[i] = np.packbits(2 * ones > len(own)).view(">u8")[0]
            some = np.flatnonzero(n)
            least = np.zeros((len(some), SAMPLES * TAKEN), np.uint64)
            if len(some):
                for k in range(SAMPLES * TAKEN):
                    with np.errstate(over="ignore"):
                        least[:, k] = np.minimum.reduceat(mix(hashes * draw[0, k] + draw[1, k]), edges[some])
            samples = np.zeros((batch.num_rows, SAMPLES), np.uint64)
            samples[some] = _majority(least.reshape(len(some), SAMPLES, TAKEN))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel())) for x in (samples, np.packbits(odd, axis=1).view(np.uint64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(n), pa.array(fps.view(np.int64)), *lists], ["doc_id", "digest", "n", "fp", "samples", "odd"])

    return run


def _sets(size: int, bits) -> Callable:
    """id, key, text -> id and the sorted shingle hashes of those that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            wanted = whole.filter(pa.array(passes(bits.value, whole.column(1).to_numpy().view(np.uint64)), pa.bool_()))
            for batch in small([wanted], 2):
                hashes, edges = shingle_hashes(batch.column(2), size)
                own = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))], ["id", "shingles"])

    return run


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """By sizes and fingerprints alone."""
    n = [F.col(f"{x}.n") for x in (a, b)]
    manhattan = F.bit_count(F.col(f"{a}.counts").bitwiseXOR(F.col(f"{b}.counts"))) <= RANGE
    return (F.least(*n) >= similarity * F.greatest(*n) - 1e-9) & manhattan & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= RANGE)


def _may_share_enough(a: str, b: str, similarity: float) -> Column:
    """By the parities: sets of that likeness differ in (1 - s) / (1 + s) of their summed sizes at most."""
    apart = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(PARTS // 64)), F.lit(0))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-9


def similar_documents(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable over links of texts whose shingle sets have a Jaccard likeness of `similarity` or more) for every doc_id of docs.

    A document is a doc_id: rows that share one count as one document with several texts. Rows of a null doc_id take no part and aren't returned. Texts of fewer words
    than `size` are one shingle; wordless texts, null ones too, are all alike. Other columns are ignored. An empty table gives no rows.

    Equal shingle sets are one class, whatever their number. In every cell of the grid all classes are first held against the least of the cell; only those that this
    leaves unconnected are then held against each other. So a group of copies costs as many comparisons as it has different texts, and no link between different texts
    that meet is lost."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = materialise(texts.mapInArrow(_sketch(size), "doc_id long, digest binary, n long, fp long, samples array<long>, odd array<long>"), "sketches")
    classes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "fp", "samples", "odd")).alias("c")).select("digest", "c.*")
    classes = materialise(classes.withColumnRenamed("doc_id", "id"), "classes")
    points = classes.where("n > 0").select("id", F.struct("n", "fp", _counts("fp").alias("counts")).alias("p"), F.posexplode("samples").alias("sample", "f"))
    keyed = points.select("id", "p", "sample", _counts("f").alias("cell"))
    cells = keyed.groupBy("sample", "cell").agg(F.count("*").alias("many"), F.min(F.struct("id", "p")).alias("hub")).where("many > 1")
    met = materialise(keyed.join(cells, ["sample", "cell"]).select("sample", "cell", "id", "p", F.col("hub.id").alias("hub"), F.col("hub.p").alias("h")), "cells")
    first = met.where("id <> hub").where(_may_be_similar("p", "h", similarity)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = materialise(first, "pairs")
    links = materialise(_similar(texts, first, size, similarity), "similar")
    roots = connected_components(links, "a", "b")
    apart = met.join(roots, met.id == roots.node, "left").select("sample", "cell", "id", F.struct("p.*", F.coalesce("root", "id").alias("root")).alias("p"))
    split = apart.groupBy("sample", "cell").agg(F.min("p.root").alias("x"), F.max("p.root").alias("y")).where("x <> y").select("sample", "cell")
    apart = apart.join(split, ["sample", "cell"]).join(classes.select("id", "odd"), "id")
    apart = materialise(apart.select("sample", "cell", "id", F.struct("p.*", "odd").alias("p")), "apart")
    a, b = apart.select("sample", "cell", F.col("id").alias("a"), F.col("p").alias("pa")), apart.select("sample", "cell", F.col("id").alias("b"), F.col("p").alias("pb"))
    rest = a.join(b, ["sample", "cell"]).where("a < b and pa.root <> pb.root").where(_may_be_similar("pa", "pb", similarity) & _may_share_enough("pa", "pb", similarity)).select("a", "b").distinct()
    rest = materialise(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.union(materialise(_similar(texts, rest, size, similarity), "similar"))
    # the classes of a doc_id with several texts are one document
    same = rows.join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    several = same.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y").select("a")
    links = links.union(same.join(several, "a").where("a <> b"))
    roots = connected_components(links, "a", "b")
    own = same.groupBy("a").agg(F.min("b").alias("b"))
    return own.join(roots, own.b == roots.node, "left").select(F.col("a").alias("doc_id"), F.coalesce("root", "b").alias("component_id"))


def _similar(texts: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose shingle sets have that likeness. Sets are made where the texts are read, of the wanted doc_ids and the few others that pass their filter."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("key"))
    bits = texts.sparkSession.sparkContext.broadcast(bit_filter(keys, BITS, MOST_BITS))
    wanted = texts.select("doc_id", F.xxhash64("doc_id").alias("key"), "text")
    sets = materialise(wanted.mapInArrow(_sets(size, bits), "id long, shingles array<long>"), "sets")
    of_a, of_b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(of_a, "a").join(of_b, "b").where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b").distinct()


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs with the least doc_id of their component; rows without a doc_id have nothing to be compared by and stay."""
    drop = found.where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def hex64(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", hex64().alias("fingerprint"), "component_id")
