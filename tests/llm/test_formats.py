import hashlib
import random
import re
import struct

import duckdb
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from sparkloom.llm import chat, decontaminate, order_minhash, queries

SF = "/root/testdata/sf0.001"


@given(hs.lists(hs.tuples(hs.text(max_size=8), hs.text(alphabet="\\#<>/turn :\nA", max_size=30)), max_size=5))
def test_the_template_reads_back(turns):
    assert chat.parse("".join(chat.format_turn(r, t)[0] for r, t in turns)) == turns


def test_what_is_no_template_is_refused():
    for bad in ("### user: a</turn>\nx", "### user: a<b</turn>\n", "user: a"):
        with pytest.raises(ValueError):
            chat.parse(bad)


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "</turn> ### x: \\"), ("user", "more"), ("assistant", "ok")],
    2: [("system", "s"), ("user", "no answer")],
    3: [("assistant", ""), ("assistant", "é" * 3), ("user", None)],
    7: [("assistant", "long </turn> " * 30_000), ("user", "x" * 100_000), ("assistant", "end")],
    None: [(None, "lost"), ("assistant", "found")],
    5: [("user", "u"), ("assistant", "a")] * 40,
}


def test_examples_and_digests(spark):
    rows = [(c, i, r, t, "extra") for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns string")
    examples = chat.expand_prefixes(table)
    for e in examples.where("conv_id = 1").collect():
        before = CONVERSATIONS[1][: e.target + 1]
        assert chat.parse(e.text) == before and chat.unescape(e.text[e.loss_start : e.loss_end]) == before[-1][1] and before[-1][0] == "assistant"
    found = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert {r.conv_id: r for r in chat.digest(examples.orderBy("n_turns", F.desc("conv_id")).repartition(5)).collect()} == found
    assert set(found) == set(CONVERSATIONS)
    for c, turns in CONVERSATIONS.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (found[c].n_turns, found[c].loss_chars) == (len(turns), len(loss))
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert found[5].formatted_chars == sum(len(e.text) for e in examples.where("conv_id = 5").collect())
    assert chat.digest(chat.expand_prefixes(table.limit(0))).count() == 0


DOCS = "doc_id long, text string, n_chars int, key string, range int"


def chained(*values):
    """xxhash64 over several values: strings and longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


def plain_signature(text):
    """Order MinHash, step by step."""
    tokens = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        tokens += [w] if len(w) <= 16 else [w[i : i + 8] for i in range(len(w) - 7)] + [w[-7:]]
    kmers = [chained(x, y) for x, y in zip(tokens, tokens[1:])] if len(tokens) > 1 else [chained(x) for x in tokens]
    mask, seen, bins = 2**order_minhash.HASH - 1, {}, {}
    for i, k in enumerate(kmers):
        seen[k & mask] = seen.get(k & mask, -1) + 1
        h = occurrence_hash(k & mask, seen[k & mask]) & mask
        bins.setdefault(h >> (order_minhash.HASH - order_minhash.BIN_BITS), []).append((h, i))
    out = []
    for b in range(order_minhash.BINS):
        two = sorted(sorted(bins.get(b, []))[:2], key=lambda x: x[1])
        out.append(chained(*[h for h, _ in two]) & 0xFFFFFFFF if two else None)
    return out


def occurrence_hash(k, occurrence):
    """xxhash64 of a long and an int."""
    return xxhash.xxh64_intdigest(struct.pack("<i", occurrence), xxhash.xxh64_intdigest(struct.pack("<q", k), 42))


def test_signatures_against_plain_ones(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcé🙂") for _ in range(n))
    texts = ["", None, " ", "a", "a b", "a a a a a a", word(16), word(17), word(25), " ".join(word(rng.choice([2, 3, 16, 17, 40])) for _ in range(300)), "x" * 3000, " ".join(["to be or not"] * 200)]
    found = order_minhash.with_signature(spark.createDataFrame(list(enumerate(t or "" for t in texts)), "i int, t string"), "t", "s").collect()
    assert {r.i: list(r.s) for r in found} == {i: plain_signature(t) for i, t in enumerate(texts)}


def test_an_insertion_leaves_most_of_an_unspaced_text(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij語文字") for _ in range(6000))
    rows = [(0, text), (1, "z" + text), (2, text[:3000] + "q" + text[3000:]), (3, "".join(rng.choice("abcdefghij語文字") for _ in range(6000)))]
    s = {r.i: r.s for r in order_minhash.with_signature(spark.createDataFrame(rows, "i int, t string"), "t", "s").collect()}
    same = lambda a, b: sum(x == y for x, y in zip(s[a], s[b]))
    assert same(0, 1) > 24 and same(0, 2) > 24 and same(0, 3) < 4


def test_order_minhash_edits_and_likeness(spark):
    rng = random.Random(2)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = {i: make(rng.choice([1, 3, 30, 200])) for i in range(0, 60, 2)} | {61: "", 63: None, 65: "x" * 5000, 67: make(6000), 69: "🙂é " * 9}
    texts[21] = texts[20]
    rows = [(i, t, 1, "k", 1) for i, t in texts.items()] + [(20, texts[20], 1, "k", 1), (None, "last of all", 1, "k", 1)]
    found = order_minhash.fingerprint_with_next(spark.createDataFrame(rows, DOCS))
    made = found.select("*", order_minhash.as_text("signature").alias("f"), order_minhash.likeness("signature", "edited_signature").alias("near"), order_minhash.likeness("signature", "next_signature").alias("next")).collect()
    assert len(made) == len(rows)
    order = sorted(((2**63 if i is None else i), t or "") for i, t, *_ in rows)
    expected = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 4
        expected.append((i, len(t), t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]))
    assert sorted(((2**63 if r.doc_id is None else r.doc_id), r.n_chars, r.edited) for r in made) == sorted(expected)
    by_id = {r.doc_id: r for r in made}
    assert by_id[20].f == by_id[21].f and by_id[61].f == by_id[63].f and by_id[61].near == 1
    long = [r for r in made if r.n_chars > 800 and r.doc_id != 65]
    assert min(r.near for r in long) > 0.05 and max(r.next for r in long) < 0.05 and all(0 <= r.near <= 1 and 0 <= r.next <= 1 for r in made)
    assert order_minhash.fingerprint_with_next(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("cuts", [[], [5], [5, 7, 8, 20, 21, 30, 44, 60, 61]])
def test_ranges_of_keys(spark, cuts):
    found = spark.range(70).withColumnRenamed("id", "key").withColumn("r", order_minhash._range_of(cuts)).collect()
    assert all(x.r == sum(c <= x.key for c in cuts) for x in found)


def test_many_ranges_have_the_same_next(spark, monkeypatch):
    rows = [(i * 3 % 101, f"text {i} of many words", 1, "k", 1) for i in range(101)]
    docs = spark.createDataFrame(rows, DOCS)
    one = {r.doc_id: r.edited for r in order_minhash.fingerprint_with_next(docs).collect()}
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 4)
    assert {r.doc_id: r.edited for r in order_minhash.fingerprint_with_next(docs).collect()} == one


def test_equal_turns_stand_in_order_of_role_and_text(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "assistant", "last"), (1, 1, "user", "c")]
    examples = chat.expand_prefixes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("target").collect()
    assert [chat.parse(e.text) for e in examples][-1] == [("assistant", "z"), ("user", "a"), ("user", "b"), ("user", "c"), ("assistant", "last")]
    assert [e.target for e in examples] == [0, 4]


def test_order_matters_and_occurrences_count(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (3, " ".join(words * 2)), (4, " ".join(words))]
    signed = {r.i: r.s for r in order_minhash.with_signature(spark.createDataFrame(rows, "i int, t string"), "t", "s").collect()}
    same = lambda a, b: sum(x == y for x, y in zip(signed[a], signed[b])) / 32
    assert same(1, 4) == 1 and 0.2 < same(1, 2) < 0.95 and 0 < same(1, 3) < 1


ITEM = "A train leaves Paris at 9 and travels 120 km in 3 hours while Anna reads 12 pages of her book about old railway lines"


def test_reparameterised_items_are_caught(spark):
    clean = "the quick river bends past seven old mills before it meets the sea near town and slows down again"
    docs = {
        1: f"intro words here {ITEM} and more words",
        2: "intro " + ITEM.replace("Paris", "Rome").replace("120", "240").replace(" 3 ", " 6 ").replace("Anna", "Otto"),
        3: ITEM.upper(),
        4: clean,
        5: "A train leaves Paris",
        6: None,
        7: "",
        8: " ".join(f"Name{i} {i}" for i in range(60)),
        9: ITEM.replace("120 km", "ninety paces").replace("reads 12", "eats no"),
    }
    rows = [(i, t, 1, "k", 1) for i, t in docs.items()] + [(None, ITEM, 1, "k", 1), (4, clean, 1, "k", 1)]
    table = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(100, ITEM, "x"), (100, ITEM, "x"), (101, "nothing like the others at all in this one", "x"), (102, None, "x"), (None, clean, "x"), (103, "", "x")], "item_id long, text string, doc_id string")
    found = decontaminate.flag(table, items)
    hits = {r.doc_id: (r["items"], r.cover) for r in found.where("contaminated").collect()}
    assert set(hits) == {1, 2, 3, None, 9} or set(hits) == {1, 2, 3, None}
    assert hits[1] == ([100], 1.0) and hits[2][1] > 0.9
    assert found.count() == len(rows) and decontaminate.clean(table, items).columns == table.columns
    assert decontaminate.clean(table, items).count() == len(rows) - len(hits)
    assert decontaminate.flag(table, items.limit(0)).where("contaminated").count() == 0 and decontaminate.clean(table.limit(0), items).count() == 0


def test_torn_slots_don_t_count(spark):
    item = "add 5 apples to 5 pears then take 5 plums away from 5 trees and give 5 cherries"
    table = spark.createDataFrame([(1, item.replace("5", "8"), 1, "k", 1), (2, "add 1 apples to 2 pears then take 3 plums away from 4 trees and give 6 cherries", 1, "k", 1)], DOCS)
    found = decontaminate.flag(table, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {r.doc_id: r.contaminated for r in found.collect()} == {1: True, 2: False}


def test_one_changed_number_voids_only_its_windows(spark):
    item = " ".join(f"{w} 5" if k in (8, 20) else w for k, w in enumerate("a farmer sells eggs on the market and keeps coins in a tin box while her son counts all hens twice a day before they walk home along the muddy road to bed".split()))
    changed = item.replace("keeps 5", "keeps 6")
    other = "Ένας Αγρότης πουλά αυγά στην αγορά της Πόλης και κρατά νομίσματα σε ένα κουτί"
    rows = [(1, changed), (2, item), (3, other.replace("Πόλης", "Σπάρτης").replace("Αγρότης", "Ψαράς")), (4, other.upper()), (5, "ordinary text about the sea and 5 hens")]
    items = spark.createDataFrame([(7, item), (8, other)], "item_id long, text string")
    assert changed != item
    found = {r.doc_id: r for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {i: list(r["items"]) for i, r in found.items()} == {1: [7], 2: [7], 3: [8], 4: [8], 5: []}
    assert 0.5 < found[1].cover < 1 == found[2].cover


def test_clashing_columns_are_kept_apart_or_replaced(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", 1, 2), (2, "clean text", "b", 3, 4)], "doc_id long, text string, items string, cover int, _id int")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    found = decontaminate.flag(docs, items)
    assert sorted(found.columns) == ["_id", "contaminated", "cover", "doc_id", "items", "text"] and {r.doc_id: list(r["items"]) for r in found.collect()} == {1: [7], 2: []}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", "b", 3, 4)]


def test_long_runs_and_short_items_are_caught(spark):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "iru", "ona", "upe", "yse", "arn", "est", "isk", "olm")]
    items = spark.createDataFrame([(1, " ".join(words[:59])), (2, "who wrote hamlet")], "item_id long, text string")
    filler = "nothing to see here at all in this plain text"
    rows = [(10, f"{filler} {' '.join(words[20:33])} {filler}"), (11, f"{filler} {' '.join(words[20:32])} {filler}"), (12, f"{filler}, who wrote Hamlet? {filler}"), (13, f"{filler} who wrote {filler} hamlet")]
    # words of two places of the item, seven in a row each, are no run
    rows += [(14, f"{' '.join(words[2:9])} {filler} {' '.join(words[30:37])}"), (15, "who wrote hamlet"), (16, filler)]
    found = {r.doc_id: r["items"] for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert found == {10: [1], 11: [], 12: [2], 13: [], 14: [], 15: [2], 16: []}


def test_slots_in_a_row_don_t_break_a_run(spark):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("alo", "emi", "iru", "ona", "upe", "yse", "arn", "est", "isk", "olm")]
    run = " ".join(words[20:25]) + " 4 km 7 kg 9 " + " ".join(words[25:30])
    items = spark.createDataFrame([(1, " ".join(words[:20]) + f" {run} " + " ".join(words[30:50]))], "item_id long, text string")
    found = decontaminate.flag(spark.createDataFrame([(1, f"so {run} so")], "doc_id long, text string"), items).first()
    assert found.contaminated and found.cover < decontaminate.COVER


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, SF).select(*names).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected.fetchall())
