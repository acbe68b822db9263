"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

A naive Bayes classifier, counted on about SAMPLE rows of the labelled table, gives every document posteriors over DOMAINS from binned statistics of its
text and from which of the WORDS most telling words it has. Then nonnegative rates are fitted, one a document: the
expected tokens of each domain, tokens times posterior times rate summed over all documents, are to equal the targets in the sense of least squares, with a slight pull (RIDGE) to equal rates.
Projected gradient steps are taken with lazy projection: a document's rate is what the sum of all steps leaves of the common rate, and zero if that is less. A step is a number for each
domain, scaled by the inverse Gram matrix of the domains over the documents that have a rate, and halved while it makes things worse; each trial is one aggregate over the
documents, of which the driver gets a few numbers per domain."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, carried, materialise, own_columns, text_of

DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}
#: Labelled documents that the classifier counts, about; drawn by a hash of doc_id.
SAMPLE = 20_000
#: Words that the classifier asks for, of every domain those that tell it best from the others.
WORDS = 128
BINS, ROUNDS, CLOSE, RIDGE = 16, 60, 1e-6, 1e-6
STATISTICS = ("length", "word_length", "signs", "capitals")


def _domain() -> Column:
    return F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)


def _bin(value: Column) -> Column:
    return F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(BINS - 1))


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, th, tokens, the different words, and the bin of each statistic."""
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.split(F.lower(text), r"[\x20\x09-\x0D]+").alias("w"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", F.array_distinct("w").alias("words"), (F.size("w") - F.array_contains("w", "").cast("int") * F.size(F.filter("w", lambda x: x == ""))).cast("long").alias("tokens"), F.length("text").alias("n"))
    n, tokens = F.greatest("n", F.lit(1)), F.greatest("tokens", F.lit(1))
    bins = (
        _bin(F.log2(n)),
        _bin(F.col("n") / tokens * 2 - 4),
        _bin(F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,]")) / n * 64),
        _bin(F.regexp_count("text", F.lit(r"\p{Lu}")) / n * 32),
    )
    return rows.select("doc_id", "th", "tokens", "words", *[b.alias(s) for b, s in zip(bins, STATISTICS)])


def _classifier(docs: DataFrame, labels: DataFrame) -> list[Column]:
    """Log posterior of each domain, up to a shared term, as columns over `_described`."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality")).select("doc_id", _domain().alias("domain"))
    share = SAMPLE / max(own.count(), 1)
    drawn = own.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) < share * (1 << 30))
    drawn = F.broadcast(drawn)  # about SAMPLE rows of two numbers
    of_drawn = _described(docs.where(F.col("doc_id").isNotNull()).join(drawn.select("doc_id"), "doc_id", "left_semi"))
    rows = materialise(of_drawn.join(drawn, "doc_id"), "mixing-rows")
    k = len(DOMAINS)
    size = np.zeros(k)
    for r in rows.groupBy("domain").count().collect():
        size[r["domain"]] = r["count"]
    table = np.ones((k, len(STATISTICS), BINS))
    for r in rows.select("domain", F.posexplode(F.array(*STATISTICS)).alias("s", "b")).groupBy("domain", "s", "b").count().collect():
        table[r["domain"], r["s"], r["b"]] += r["count"]
    table = np.log(table / table.sum(2, keepdims=True))
    counts = rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.sum((F.col("domain") == i).cast("long")).alias(f"c{i}") for i in range(k)])
    rate = [(F.col(f"c{i}") + 0.5) / F.lit(float(size[i] + 1)) for i in range(k)]
    every = sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    mean = (every + 0.5 * k) / F.lit(float(size.sum() + k))
    # how far a word's rate in a domain is above the common one, in documents
    told = [F.round(F.col(f"c{i}") * F.log(rate[i] / mean), 9) for i in range(k)]
    best = list({r["word"]: r for t in told for r in counts.where(every >= 5).orderBy(F.desc(t), "word").limit(WORDS).collect()}.values())
    out = []
    listed = F.array(*[F.lit(r["word"]) for r in best]).cast("array<string>")
    logs = F.create_map(*[x for r in best for x in (F.lit(r["word"]), F.array(*[F.lit(math.log((r[f"c{i}"] + 0.5) / (size[i] + 1))) for i in range(k)]))]) if best else None
    present = F.transform(F.array_intersect("words", listed), lambda w: F.element_at(logs, w)) if best else F.array().cast("array<array<double>>")
    for i in range(k):
        total = F.lit(math.log((size[i] + 1) / (size.sum() + k)))
        for j, s in enumerate(STATISTICS):
            total = total + F.element_at(F.array(*[F.lit(float(x)) for x in table[i, j]]), F.col(s) + 1)
        out.append(total + F.aggregate("present", F.lit(0.0), lambda a, x: a + x[i]))  # noqa: B023
    return [present, *out]


def soft_membership(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, th (64-bit hash of the text), tokens and the posterior p_DOMAIN of each domain, for every row; null texts are empty. Without labels all domains are as likely."""
    described = _described(docs)
    present, *logs = _classifier(docs, labels)
    rows = described.withColumn("present", present).select("doc_id", "th", "tokens", *[x.alias(f"l{i}") for i, x in enumerate(logs)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(len(logs))])
    rows = rows.select("doc_id", "th", "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(len(logs))])
    total = sum((F.col(f"e{i}") for i in range(len(logs))), F.lit(0.0))
    return rows.select("doc_id", "th", "tokens", *[(F.col(f"e{i}") / total).alias(f"p_{d}") for i, d in enumerate(DOMAINS)])


def with_rates(soft: DataFrame, targets: dict[str, float]) -> DataFrame:
    """`soft` and the rate of each row, which replaces a column of that name, for targets given as multiples of all tokens."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    k = len(p)
    target = np.array([targets[d] for d in DOMAINS])
    common = float(target.sum())
    every = soft.agg(F.sum("tokens")).first()[0]
    if not every:
        return soft.withColumn("rate", F.lit(1.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def rate(steps: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(common) - sum((x * float(s) for x, s in zip(p, steps)), F.lit(0.0)))

    def tried(steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """What the steps cost, how it changes with them, and how that changes."""
        rows = soft.withColumn("rate", rate(steps))
        used = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0.0)
        got = rows.agg(F.sum(F.col("tokens") * F.col("rate") ** 2), *[F.sum(F.col("tokens") * F.col("rate") * x) for x in p], *[F.sum(used * p[i] * p[j]) for i, j in pairs]).first()
        gram = RIDGE * np.eye(k)
        for (i, j), g in zip(pairs, got[1 + k :]):
            gram[i, j] += g / every
            if i != j:
                gram[j, i] += g / every
        return got[0] / every / 2 + steps @ target + RIDGE * steps @ steps / 2, target + RIDGE * steps - np.array(got[1 : 1 + k]) / every, gram

    steps = np.zeros(k)
    cost, slope, gram = tried(steps)
    length = 1.0
    for _ in range(ROUNDS):
        if np.abs(slope).max() < CLOSE * max(target.max(), 1e-12) or length < 1e-6:
            break
        ahead = -np.linalg.solve(gram, slope)
        now = tried(steps + length * ahead)
        if now[0] <= cost + 1e-4 * length * (slope @ ahead) + 1e-12 * abs(cost):
            steps, (cost, slope, gram), length = steps + length * ahead, now, 1.0
        else:  # too far, past the point where more rates became zero
            length /= 2
    return soft.withColumn("rate", rate(steps))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, th, tokens, posteriors and rate for every row of docs: by how much to weigh it so that the domains' expected
    tokens are the targets, in multiples of all tokens. Repeated rows get equal rates; a null doc_id makes no difference. Targets that no
    nonnegative rates can meet are met as closely as least squares allow. Other columns are ignored; an empty table gives no rows."""
    soft = materialise(soft_membership(docs, labels), "mixing")
    return with_rates(soft, targets)


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs with rate and copy, which replace columns of those names, as often as the rate says: its whole part, and once more for that share of documents,
    drawn by a hash of doc_id and text. copy counts from 1; a row with no copy is left out. Null and empty texts have no tokens but a rate like any other; an
    empty table gives no rows."""
    rated = mix(docs, labels, targets).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("th").alias("_th"), "rate").dropDuplicates(["_id", "_th"])
    draw = F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    rows = carried(docs).join(rated, ["_id", "_th"]).withColumn("_times", times).where("_times > 0")
    return rows.select(*own_columns(docs, "rate", "copy"), "rate", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("th")
