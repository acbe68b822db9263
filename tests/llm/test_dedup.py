import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from sparkloom.llm import components, simhash, suffix_bwt, suffix_tree, windows
from sparkloom.llm.common import SLICE_BYTES, stretch_hashes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kd long, th string"
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "x") for i, t in rows], SCHEMA)


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, out = make(80), []
    for i in range(n):
        t = make(rng.choice([3, 40, 120, 300]))
        if i % 3 == 0:
            t = make(rng.randint(1, 60)) + "\n" + passage + " \t" + t
        out.append((i * 2, t))
    out += [(1, out[5][1]), (301, out[5][1]), (303, out[9][1] + " tail"), (305, "word " * 400), (307, "ab" * 900), (309, None), (311, ""), (313, " \n"), (None, out[0][1]), (None, make(70)), (315, make(4000))]
    return out + [out[3], out[20]]  # repeated rows


def simhash_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def closure(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in items}


def test_fingerprints_and_components(spark):
    rows = corpus() + [(401, "A b C"), (403, "a B c"), (405, "x"), (407, "x y")]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {(i, t): simhash_of(t) for i, t in rows}
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in found) == sorted((i or -1, fps[i, t]) for i, t in rows)
    root = closure(sorted(set(fps.values())), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, t), f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert sorted(repr((r.doc_id, r.component_id)) for r in found) == sorted(repr((i, least.get(root[fps[i, t]]))) for i, t in rows)


def test_very_long_texts_have_their_whole_fingerprint():
    rng = random.Random(3)
    text = " ".join(f"W{rng.randrange(900)}" for _ in range(simhash.BLOCK + 5000))
    assert simhash.fingerprint(text.encode()) == simhash_of(text)
    word = "w" * (SLICE_BYTES + 10)
    data = np.frombuffer(f"{word} b {word} c b {word}x".encode(), np.uint8)
    begins, ends, _ = words_of(data, np.array([0, len(data)]))
    hashes = stretch_hashes(data, begins, ends)
    assert hashes[0] == hashes[2] != hashes[5] and hashes[1] == hashes[4] != hashes[3]


@pytest.mark.parametrize("cell", [64, 1])
def test_links_of_fingerprints_in_full_and_crowded_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ (1 << rng.randrange(64) if k % 3 else 0) ^ (1 << rng.randrange(64) if k % 2 else 0) for b in base for k in range(8)} | {0, 2**64 - 1, 2**63})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 2 for r in links.collect())
    roots = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    expected = closure(signed, lambda a, b: bin((a ^ b) % 2**64).count("1") <= 2)
    assert {x: roots.get(x, x) for x in signed} == expected


def test_components_of_chains_loops_and_nothing(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60), (None, 3), (70, 71), (71, 72), (72, 70)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(31)} | {60: 60, 61: 60, 70: 70, 71: 70, 72: 70}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_first_of_each_keeps_one(spark):
    docs = frame(spark, [(4, "a b c d"), (2, "a b c d"), (9, "other words here now"), (None, "a b c d")])
    kept = simhash.first_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 9]


def near_copies(seed):
    """Chains, crowds and pairs of near copies, of which some are just below the likeness."""
    rng, rows = random.Random(seed), []
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for n in (6, 12, 40, 90, 200, 700):
        base = make(n)
        for _ in range(25):
            now = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, n // 60, n // 30, n // 20])):
                now[rng.randrange(n)] = f"x{rng.randrange(99999)}"
            rows.append(" ".join(now).title() if rng.random() < 0.3 else "  ".join(now))
            if rng.random() < 0.2:
                base = now  # a chain that drifts away
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, "\n "), (903, "one two"), (904, "ONE two"), (905, "one three"), (910, " ".join(make(30_000))), (None, rows[0]), (None, None)]


@pytest.mark.parametrize("seed", [1])
def test_similar_documents_against_brute_force(spark, seed):
    rows = near_copies(seed)
    rows += [(911, rows[-3][1] + " more"), (3, rows[3][1])]  # a repeated row
    sets = {i: shingles(t) for i, t in rows if i is not None}
    expected = closure(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert found == expected and expected[902] == 900 and expected[904] == 903 and expected[911] == 910
    assert simhash.similar_documents(frame(spark, [])).count() == simhash.similar_documents(frame(spark, [(None, "a")])).count() == 0


def test_a_doc_id_with_several_texts_is_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (7, "a b c d e f"), (3, "q r s t u v"), (9, "other")]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame(spark, rows)).collect()}
    assert found == {3: 3, 5: 3, 7: 3, 9: 9}


PATHS = [(1024, 1 << 15), (1, 1000), (1, 1)]


def test_groups_of_very_long_words_are_split(spark, monkeypatch):
    monkeypatch.setattr(windows, "MOST_BYTES", 5000)
    words = [f"{i}" * 500 for i in range(60)]
    rows = [(i, " ".join([f"a{i}", *words[: 50 + i], f"b{i}"])) for i in range(8)]
    found = {r.doc_id: r.n_removed for r in suffix_tree.dedup_windows(frame(spark, rows)).collect()}
    assert found == {0: 0, 1: 50, 2: 51, 3: 52, 4: 53, 5: 54, 6: 55, 7: 56}


@pytest.mark.parametrize("crowd,long", PATHS)
def test_word_windows_against_brute_force(spark, monkeypatch, crowd, long):
    monkeypatch.setattr(windows, "CROWD", crowd)
    monkeypatch.setattr(windows, "LONG_CROWD", long)
    rows = corpus()
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            key, i_ = tuple(w[k : k + 50]), 2**63 if i is None else i
            least[key] = min(least.get(key, i_), i_)
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < (2**63 if i is None else i):
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i or -1, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = suffix_tree.dedup_windows(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(expected)


@pytest.mark.parametrize("crowd,long", PATHS)
def test_repeats_inside_a_document_and_rows_of_one_doc_id(spark, monkeypatch, crowd, long):
    monkeypatch.setattr(windows, "CROWD", crowd)
    monkeypatch.setattr(windows, "LONG_CROWD", long)
    for seed in range(3):
        u, v, x, y, p = ([f"{c}{seed}w{i}" for i in range(60)] for c in "uvxyp")
        q = [f"q{seed}w{i}" for i in range(150)]
        rows = [(1, u + p + v), (2, x + p + y + x + p + y), (3, x + p + y), (3, v + x + p + y + v)]
        rows += [(4, u[:30] + q[30:110] + v[:30]), (5, x[:20] + q + y[:25] + q + v[:10]), (5, y + q), (2**63 - 1, q + q[40:] + x), (2**63 - 1, u + q)]
        least, expected = {}, []
        for i, w in rows:
            for k in range(len(w) - 49):
                least[tuple(w[k : k + 50])] = min(least.get(tuple(w[k : k + 50]), i), i)
        for i, w in rows:
            gone = [False] * len(w)
            for k in range(len(w) - 49):
                if least[tuple(w[k : k + 50])] < i:
                    gone[k : k + 50] = [True] * 50
            expected.append((i, sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone) if not g).encode()).hexdigest()))
        assert (2, 120) in [e[:2] for e in expected]
        found = suffix_tree.dedup_windows(frame(spark, [(None if i == 2**63 - 1 else i, " ".join(w)) for i, w in rows])).collect()
        assert sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_removed, r.kept_sha256) for r in found) == sorted(expected)


@pytest.mark.parametrize("crowd,long", PATHS)
def test_byte_windows_against_brute_force(spark, monkeypatch, crowd, long):
    monkeypatch.setattr(windows, "CROWD", crowd)
    monkeypatch.setattr(windows, "LONG_CROWD", long)
    rows = corpus(5, 40)
    texts, seen, expected = [(t or "").encode() for _, t in rows], {}, []
    for t in texts:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        expected.append((i or -1, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    found = suffix_bwt.dedup_bytes(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == sorted(expected)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert suffix_tree.dedup_windows(docs).count() == suffix_bwt.dedup_bytes(docs).count() == simhash.near_duplicates(docs).count() == 0
    assert suffix_tree.cut_documents(docs).columns == docs.columns


def test_cut_documents(spark):
    rows = corpus()
    docs = frame(spark, rows)
    n = {(r.doc_id, r.n_words - r.n_removed) for r in suffix_tree.dedup_windows(docs).where("n_removed > 0").collect()}
    kept = {r.doc_id: r for r in suffix_tree.cut_documents(docs).where("doc_id is not null").collect()}
    for i, left in n:
        if i is not None:
            assert (i not in kept) if left == 0 else (len(kept[i].text.split()) == left and kept[i].n_chars == len(kept[i].text))
    assert kept[315].text == dict(rows)[315]


def test_deep_nodes_of_the_suffix_tree():
    rng = np.random.default_rng(5)
    texts = [list(rng.integers(0, 3, rng.integers(1, 14))) for _ in range(25)]
    words, left = np.array([x for t in texts for x in t]), np.array([k for t in texts for k in range(len(t), 0, -1)])
    suffixes = [(tuple(t[i:]), d) for d, t in enumerate(texts) for i in range(len(t))]
    order, common = suffix_tree.sorted_suffixes(words, left)
    assert [suffixes[i][0] for i in order] == sorted(s for s, _ in suffixes)
    shared = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert list(common[1:]) == [shared(suffixes[a][0], suffixes[b][0]) for a, b in zip(order, order[1:])]
    kd = rng.integers(0, 6, len(texts))
    of = np.array([kd[d] for _, d in suffixes])
    found = suffix_tree.deep_repeats(common, of[order], 4)
    for i, length in zip(order, found):
        most = max((shared(suffixes[i][0], s) for (s, _), k in zip(suffixes, of) if k < of[i]), default=0)
        assert length == (most if most >= 4 else 0)


def test_merged_transforms_are_sorted_suffixes():
    rng = np.random.default_rng(1)
    texts = [list(rng.integers(1, 4, rng.integers(0, 12))) for _ in range(30)]
    depth, orders, before, shards = 5, [], [], [texts[:10], texts[10:11], texts[11:]]
    every = []
    for shard in shards:
        block = np.array([x for t in shard for x in [*t, 0]], np.int32)
        left = np.array([k for t in shard for k in range(len(t), -1, -1)])
        order = suffix_bwt.shard_order(block, left, depth)
        suffixes = [tuple(t[i:][:depth]) for t in shard for i in range(len(t) + 1)]
        ahead = [t[i - 1] if i else 0 for t in shard for i in range(len(t) + 1)]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        orders.append([suffixes[i] for i in order])
        before.append(np.array([ahead[i] for i in order], np.int32))
        every += suffixes
    source, common = suffix_bwt.merge_transforms(before, depth)
    place = [0] * len(shards)
    merged = []
    for s in source:
        merged.append(orders[s][place[s]])
        place[s] += 1
    assert merged == sorted(every)
    for i in range(1, len(merged)):
        shared = next((k for k, (x, y) in enumerate(zip(merged[i - 1], merged[i])) if x != y), min(len(merged[i - 1]), len(merged[i])))
        assert common[i] == (depth if merged[i - 1] == merged[i] else shared)


def test_long_texts_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    edges = np.array([0, 1200, 1200, 5000])
    starts = lambda r: sorted((int(row), s, int(a), int(h)) for row, f, l, a, h in zip(*r) for s in range(f, l))
    whole = starts(windows.anchor_runs(data, edges, suffix_bwt.BYTES))
    monkeypatch.setattr(windows, "SLICE_BYTES", 700)
    assert starts(windows.anchor_runs(data, edges, suffix_bwt.BYTES)) == whole
    assert len(whole) == (1200 - 199) + (3800 - 199)
