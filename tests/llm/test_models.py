import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language, mixing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
LABELS = "doc_id long, quality int, toxic int, text string"
SOUND = {"en": ["th", "ing", "er", "ou", "sh"], "de": ["sch", "ung", "ei", "ä", "cht"], "es": ["ción", "os", "lla", "ñ", "ue"]}


def word(rng, lang):
    return "".join(rng.choice(SOUND[lang]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(420):
        lang, toxic, good = rng.choice(list(SOUND)), i % 5 == 0, i % 3 != 0
        words = [word(rng, lang) for _ in range(rng.choice([12, 60, 200]))]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten"])
        text = " ".join(words) + "." if good else " | ".join(words)
        docs.append((i, text, lang, "s", len(text), 0.5, 3))
        labels.append((i, int(good), int(toxic), "x"))
    docs += [(9001, None, "en", "s", 0, None, None), (9002, "", None, "s", 0, None, None), (9003, "123 !!", "en", "s", 6, None, None), (9004, "日本語", None, "s", 3, None, None), (None, docs[1][1], None, None, None, None, None), docs[7], (9005, " ".join(word(rng, "de") for _ in range(30_000)), "de", "s", 1, None, None)]
    labels += [(0, 0, 0, "y"), (None, 1, 1, None), (3, None, None, None), (77_777, 1, 0, None), (9001, 0, 0, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), docs, labels


def held_out(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_toxicity_on_held_out_rows(data):
    docs, labels, rows, _ = data
    found = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.doc_id is not None and r.doc_id < 420 and held_out(r.doc_id, 5, 0)]
    assert len(unseen) > 40 and sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in unseen) / len(unseen) > 0.95
    assert len({r.score for r in found if r.doc_id == 7}) == 1


def test_toxicity_without_labels(data):
    docs, labels, *_ = data
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def kneser_ney(rows):
    """Log ratios of a word after another (None at the start), in plain dictionaries. rows: (words, toxic)."""
    words, pairs = {}, {}
    for w, toxic in rows:
        for i, x in enumerate(w):
            words.setdefault(x, [0, 0])[toxic] += 1
            if i:
                pairs.setdefault((w[i - 1], x), [0, 0])[toxic] += 1
    own = lambda c: [max(x - toxicity.DISCOUNT, 0) if sum(c) >= toxicity.RARE else 0 for x in c]
    contexts = {w: 0.5 + sum(b == w for _, b in pairs) for w in words}
    total = [sum(own(c)[k] for c in words.values()) for k in (0, 1)]
    back = toxicity.DISCOUNT * sum(sum(c) >= toxicity.RARE for c in words.values()) / sum(map(sum, words.values()))
    p = {w: [(1 - back) * own(c)[k] / max(total[k], 1e-9) + back * contexts[w] / sum(contexts.values()) for k in (0, 1)] for w, c in words.items() if sum(c) >= toxicity.RARE}
    left, kept = {}, {}
    for a in words:
        mine = [c for (x, _), c in pairs.items() if x == a]
        kept[a] = [sum(own(c)[k] for c in mine) for k in (0, 1)]
        left[a] = max(1 - kept[a][k] / sum(c[k] for c in mine) if sum(c[k] for c in mine) else 1 for k in (0, 1))

    def ratio(a, b):
        if b not in p:
            return 0.0
        z = left.get(a, 1) if a is not None else 1
        alone = np.log(p[b][1] / p[b][0])
        if z == 1 or (a, b) not in pairs:
            return alone
        both = np.log(np.divide(*[(1 - z) * own(pairs[a, b])[k] / kept[a][k] + z * p[b][k] for k in (1, 0)]))
        return both if abs(both - alone) >= toxicity.CLOSE else alone

    return ratio


def test_ratios_against_plain_kneser_ney(spark, monkeypatch):
    rng, docs, labels = random.Random(6), [], []
    for i in range(160):
        bad = i % 4 == 0
        words = [rng.choice("the a of to and in bad is foul it was not".split()[: 12 if bad else 9]) if rng.random() < 0.8 else f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 7, 30, 90]))]
        docs.append((i, " ".join(words) if i % 9 else " ".join(words).upper()))
        labels.append((i, int(bad)))
    docs += [(500, None), (501, ""), (502, " "), (None, docs[3][1]), (503, "unseen words only"), (504, docs[8][1] + " " + "the bad " * 40_000)]
    frame, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, own)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ratio = kneser_ney([(t.lower().split(), bad) for (i, t), (_, bad) in zip(docs, labels) if fold(i) not in (0, 4)])
    expected = []
    for i, t in docs:
        w = (t or "").lower().split()
        each = [ratio(a, b) for a, b in zip([None, *w], w)]
        parts = sorted((np.mean(each[k : k + 2]) for k in range(0, len(w), 2)), reverse=True)
        expected.append((i or -1, sum(parts[:2]) / 2, np.mean(each) if w else 0.0))
    for block in (toxicity.BLOCK, 2000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        found = sorted((r.doc_id or -1, r.top, r.mean) for r in toxicity.score_toxicity(frame.coalesce(1), model).collect())
        assert np.allclose(found, sorted(expected), atol=1e-6)


def test_toxicity_held_or_in_tables(data, monkeypatch):
    docs, labels, *_ = data
    kept, tables = toxicity.materialise, []
    monkeypatch.setattr(toxicity, "materialise", lambda df, name: tables.append(name) or kept(df, name))
    of = lambda found: sorted((r.doc_id or -1, round(r.score, 9), r.top, r.mean) for r in found.collect())
    held = toxicity.fit(docs, labels)
    expected = of(toxicity.score_toxicity(docs, held))
    assert tables == ["toxicity-counts", "toxicity-words", "toxicity-entries"]  # no text is written or dealt out
    for most in (0, len(held.held[0]) // 2):
        monkeypatch.setattr(toxicity, "MOST_HELD", most)
        monkeypatch.setattr(toxicity, "MOST_LABELS", most)
        model = toxicity.fit(docs, labels)
        assert len(model.held[0]) <= most and model.rest.count() + len(model.held[0]) == len(held.held[0])
        assert of(toxicity.score_toxicity(docs, model)) == expected


def test_toxicity_counts_are_packed():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) % 5000) for _ in range(300)]
    made = list(toxicity._count(4)(iter([pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), pa.array([0, 1, 0] * 100)], ["doc_id", "text", "toxic"])])))
    counts = {}
    for x in pa.Table.from_batches(made).to_pandas().groupby("part"):
        part = toxicity._sum_part(pa.Table.from_pandas(x[1], preserve_index=False)).to_pylist()
        counts |= {r["key"]: r["c0"] + r["c1"] for r in part if r["a"] is not None}
    plain = Counter(p for t in texts for p in zip(t.split(), t.split()[1:]))
    assert sorted(counts.values()) == sorted(n for n in plain.values() if n >= toxicity.RARE)
    assert sum(b.nbytes for b in made) < 10 * len(plain)  # a row of Spark's takes 48 bytes


def test_language_on_held_out_rows(data):
    docs, _, rows, _ = data
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    unseen = [r for r in rows if r[0] is not None and r[0] < 420 and held_out(r[0], 3, 1)]
    assert sum(found[r[0]].lang_pred == r[2] for r in unseen) / len(unseen) > 0.97
    assert [found[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and found[9004].lang_pred != "und"
    assert found[9005].lang_pred == "de" and all(0 <= r.score <= 1 for r in found.values())
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    # a passage in another language keeps its own labels
    rng = random.Random(5)
    text = " ".join([word(rng, "en") for _ in range(20)] + [word(rng, "es") for _ in range(20)])
    _, at = None, np.array([0, len(text.encode())])
    _, _, p = language.label_words(model, np.frombuffer(text.encode(), np.uint8), at)
    labels = [model.languages[i] for i in p.argmax(1)]
    assert labels[:15].count("en") > 12 and labels[-15:].count("es") > 12


def test_every_language_is_learned(spark):
    rng, rows = random.Random(8), []
    for i in range(70):
        sounds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        text = lambda n: " ".join("".join(rng.choice(sounds) for _ in range(2)) for _ in range(n))  # noqa: E731, B023
        rows += [(100 * i + j, text(40), f"l{i:02}") for j in range(6)]
    rows += [(8000 + j, "zuk zak " * 14_000 + f"zok{j}", "long") for j in range(6)]  # over 100,000 characters each
    rows += [(None, "quorx quirx", "copies") for _ in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted({r[2] for r in rows})
    found = language.identify(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) / len(found) > 0.97
    assert {r.lang_pred for r in found if r.doc_id and r.doc_id >= 8000} == {"long"} and {r.lang_pred for r in found if r.doc_id is None} == {"copies"}


def test_language_without_training_rows(data):
    docs, *_ = data
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_without_a_language_only_letterless_texts_go(data):
    docs, _, rows, _ = data
    model = language.fit(docs.withColumn("lang", docs.lang.substr(1, 0)).where("lang is null"))
    assert model.languages == [] and language.keep_known(docs, model).count() == len(rows) - 3


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(4)
    scores, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    size = np.array([4, 2])
    p, expected = language.forward_backward(scores, size, moves)
    total = np.zeros((3, 3))
    for c, n in enumerate(size):
        weight, marginal, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(scores[c, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        assert np.allclose(p[c, :n], marginal / weight)
        total += pairs / weight
    assert np.allclose(expected, total)


def test_quality_on_held_out_rows(data):
    docs, labels, rows, _ = data
    measured = quality.measure(docs)
    found = quality.score_quality(measured, quality.fit(measured, labels)).collect()
    unseen = [r for r in found if r.doc_id is not None and r.doc_id < 420 and held_out(r.doc_id, 5, 0)]
    assert sum((r.score >= 0.5) == (r.doc_id % 3 != 0) for r in unseen) / len(unseen) > 0.95
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert quality.score_quality(measured.limit(0), quality.grow(np.zeros((0, 21)), np.zeros(0))).count() == 0


def test_statistics_of_small_texts():
    x = quality.statistics(pa.array(["", "A b.\nA b.\n1", None, "é é é"]))
    name = {n: x[:, i] for i, n in enumerate(quality.STATISTICS)}
    assert (x[0] == 0).all() and (x[2] == 0).all()
    assert np.allclose(name["distinct_words"], [0, 3 / 5, 0, 1 / 3]) and np.allclose(name["distinct_lines"], [0, 2 / 3, 0, 1])
    assert np.allclose(np.expm1(name["log_chars"]), [0, 11, 0, 5]) and np.allclose(name["repeated_ahead"], [0, 0, 0, 2 / 3])


def test_flat_trees_agree_with_walking():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.grow(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    for row in x[:20]:
        total = trees.offset
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert np.isclose(trees.score(row[None])[0], 1 / (1 + np.exp(-total)))


def plain_posteriors(docs, labels):
    """Naive Bayes over binned statistics and telling words, in plain dictionaries; every labelled row is in the sample."""
    k, of = 3, {}
    for i, q, t, *_ in labels:
        if i is not None and q is not None and t is not None:
            a = of.get(i, (0, 0))
            of[i] = (max(a[0], t), max(a[1], q))
    of = {i: 2 if t > 0 else 0 if q > 0 else 1 for i, (t, q) in of.items()}

    def described(text):
        text = text or ""
        tokens = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        n, m = max(len(text), 1), max(len(tokens), 1)
        signs = sum(not (unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\x0c\r.,") for c in text)
        values = [np.log2(n), len(text) / m * 2 - 4, signs / n * 64, sum(unicodedata.category(c) == "Lu" for c in text) / n * 32]
        return [min(max(int(v), 0), mixing.BINS - 1) for v in values], set(re.split(r"[\x20\x09-\x0D]+", text.lower()))

    rows = [(of[i], *described(t)) for i, t, *_ in docs if i in of]
    size = np.bincount([r[0] for r in rows], minlength=k)
    table = np.ones((k, 4, mixing.BINS))
    counts = {}
    for d, bins, words in rows:
        for s, b in enumerate(bins):
            table[d, s, b] += 1
        for w in words:
            counts.setdefault(w, [0] * k)[d] += 1
    table = np.log(table / table.sum(2, keepdims=True))
    rate = lambda c: [(x + 0.5) / (size[i] + 1) for i, x in enumerate(c)]
    told = {w: [round(x * np.log(r / ((sum(c) + 0.5 * k) / (size.sum() + k))), 9) for x, r in zip(c, rate(c))] for w, c in counts.items() if sum(c) >= 5}
    best = {w: np.log(rate(counts[w])) for i in range(k) for w in sorted(told, key=lambda w: (-told[w][i], w))[: mixing.WORDS]}
    out = []
    for i, t, *_ in docs:
        bins, words = described(t)
        log = np.log((size + 1) / (size.sum() + k)) + sum(table[:, s, b] for s, b in enumerate(bins)) + sum((best[w] for w in words if w in best), np.zeros(k))
        out.append((i, *(np.exp(log - log.max()) / np.exp(log - log.max()).sum())))
    return out


def test_posteriors_against_plain_naive_bayes(data):
    docs, labels, rows, marks = data
    found = mixing.soft_membership(docs, labels).select("doc_id", *[f"p_{d}" for d in mixing.DOMAINS]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 5))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(plain_posteriors(rows, marks), key=key), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], atol=1e-6)


def test_mixing_meets_the_targets(data):
    docs, labels, rows, _ = data
    found = mixing.mix(docs, labels).toPandas()
    assert len(found) == len(rows) and (found.rate >= 0).all()
    for domain, target in mixing.TARGETS.items():
        assert abs((found.tokens * found.rate * found[f"p_{domain}"]).sum() / found.tokens.sum() - target) < 1e-3
    assert np.allclose(found[[f"p_{d}" for d in mixing.DOMAINS]].sum(1), 1)
    mean = found[found.doc_id < 420].groupby(found.doc_id % 5 == 0)["p_toxic"].mean()
    assert mean[True] > mean[False] + 0.3
    out = mixing.mixed_documents(docs, labels)
    assert out.columns == [*docs.columns, "rate", "copy"] and out.count() > 0
    clashing = mixing.mixed_documents(docs.withColumns({"rate": F.lit("x"), "times": F.lit(3), "_id": F.lit(1)}), labels)
    assert clashing.columns == [*docs.columns, "times", "_id", "rate", "copy"] and clashing.count() == out.count()
    assert mixing.mix(docs.limit(0), labels).count() == 0 and mixing.mix(docs, labels.limit(0)).count() == len(rows)


def test_targets_that_no_rates_can_meet(spark):
    soft = spark.createDataFrame([(10, 1.0, 0.0, 0.0), (30, 0.5, 0.5, 0.0)], "tokens long, p_good double, p_poor double, p_toxic double")
    got = mixing.with_rates(soft, {"good": 0.1, "poor": 0.9, "toxic": 0.0}).orderBy("tokens").collect()
    assert got[0].rate < 0.05 and got[1].rate > 0.5
