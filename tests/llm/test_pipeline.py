import corpus_pipeline
from sparkloom.llm import decontaminate
from sparkloom.llm.common import materialise, table
from sparkloom.session import discard, written
from test_dedup import closure, shingles

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        assert after.columns[: len(columns)] == columns
        if name != "source_mixing":
            assert after.dtypes == docs.dtypes
        rows, kept = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert kept and set(kept) <= set(rows)
        gone = set(rows) - set(kept)
        if name == "language_id":
            assert all(not any(c.isalpha() for c in rows[i].text) for i in gone)
            assert all(any(c.isalpha() for c in r.text) for r in kept.values())
        elif name == "simhash_near_dedup":
            sets = {i: shingles(r.text) for i, r in rows.items()}
            least = closure(sorted(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
            assert set(kept) == {i for i in least if least[i] == i} and gone
        elif name == "substring_dedup":
            seen: dict[tuple, int] = {}
            for i in sorted(rows):
                w = rows[i].text.split()
                bad = [False] * len(w)
                for k in range(len(w) - 49):
                    if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                        bad[k : k + 50] = [True] * 50
                left = [x for x, b in zip(w, bad) if not b]
                assert (i in kept) == (bool(left) or not w)
                if i in kept:
                    assert kept[i].text == (" ".join(left) if any(bad) else rows[i].text)
        elif name == "benchmark_decontamination":
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert {i for i, r in rows.items() if any(t in r.text for t in items)} <= gone
            flagged = decontaminate.flag(before, table(spark, SF, "benchmark"))
            assert gone == {r.doc_id for r in flagged.where("contaminated").collect()}
        else:
            assert all(r.copy >= 1 and r.rate > 0 for r in kept.values())
        before = spark.createDataFrame(after.select(*columns).dropDuplicates(["doc_id"]).collect(), docs.schema)


def test_run_is_the_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"expected-{name}")
    before = written()
    found = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, docs.collect()))
    discard(spark, before)
    assert written() == before


def test_stages_over_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_the_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
