import math

import pytest
from pyspark.sql import functions as F

from sparkloom import cli
from sparkloom.errors import ConfigError, CorruptFile, PlanError, SchemaError
from sparkloom.operators.aggregates import Aggregate
from sparkloom.operators.sorting import SortKey
from sparkloom.plans import observe
from sparkloom.sources import parquet
from sparkloom.sources.catalogue import Catalogue
from sparkloom.statistics import tables as st
from sparkloom.streaming import pipeline
from sparkloom.verify.compare import agree


@pytest.fixture(scope="module")
def numbers(spark):
    n = F.col("id")
    return spark.range(4000).select(n.alias("id"), ((n * 7919) % 1000).alias("k"), ((n * 104729) % 977).alias("m"), F.when(n % 10 != 0, (n % 7).cast("string")).alias("s"), (n * 0.5).alias("v"))


@pytest.mark.parametrize("order", ["arrival", "sorted", "clustered", "interleaved"])
def test_layouts_keep_rows_and_prune(spark, numbers, tmp_path, order):
    path = str(tmp_path / "t")
    parquet.write(numbers, path, order, [] if order == "arrival" else ["k", "m"] if order == "interleaved" else ["k"], files=8)
    table = parquet.open_table(spark, path)
    assert agree(table, numbers)
    found = parquet.report(table, (F.col("k") < 50) & (F.col("m") < 400))
    assert found.rows == 4000 and found.rows_kept == numbers.where("k < 50 and m < 400").count()
    if order in ("sorted", "interleaved"):
        assert found.skipped_share > 0.4
    pruned = parquet.scan(table, ["v"], F.col("k") == 3)
    assert set(observe.read_columns(pruned)) == {"k", "v"} and "EqualTo(k,3)" in "".join(observe.pushed_filters(pruned)).replace(" ", "") or "k" in str(observe.pushed_filters(pruned))
    assert sum(1 for _ in parquet.batches(table, ["id"], F.col("k") < 10)) == numbers.where("k < 10").count()


@pytest.mark.parametrize("order", ["sorted", "clustered", "interleaved"])
def test_tasks_sort_no_more_rows_in_larger_tables(spark, monkeypatch, order):
    from sparkloom import queries

    monkeypatch.setattr(queries, "ROWS_PER_TASK", 250)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    stored = queries._stored(spark, "/root/testdata/sf0.001", order, *(["l_orderkey", "l_partkey"] if order == "interleaved" else ["l_orderkey"]))
    found = parquet.files(stored)
    assert found.count() > 16 and found.agg(F.max("rows")).first()[0] < lines.count() / 8
    assert agree(stored, lines.select(*stored.columns))


def test_fragments_zone_maps_and_refusals(spark, numbers, tmp_path):
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    parquet.ingest(numbers.coalesce(1), small, 100)
    done = parquet.compact(spark, small, large, order="sorted", keys=["k"])
    assert done.files_before == 40 and done.files_after == 1 and done.break_even < math.inf
    assert agree(parquet.open_table(spark, large), numbers)
    zone = parquet.zone_map(parquet.open_table(spark, large), ["k", "s"]).where("column_name = 's'").first()
    assert zone.nulls == 400 and zone.low == "0"
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"not parquet at all")
    for path in (str(bad), str(tmp_path / "none")):
        with pytest.raises(CorruptFile):
            parquet.open_table(spark, path)
    with pytest.raises(ConfigError):
        parquet.write(numbers, str(tmp_path / "x"), "sideways")


def test_footers_and_bloom_filters(spark, numbers, tmp_path):
    path = str(tmp_path / "t")
    parquet.write(numbers, path, "sorted", ["id"], files=4, bloom={"k": (1000, 0.01)})
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert tuple(parquet.footer_facts(spark, path, ["id", "v"]).first()) == (4000, 0, 3999, 0.0, 1999.5)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    assert parquet.bloom_bytes(1000, 0.01) == 1199
    import glob

    import pyarrow.parquet as pq

    sizes = [(c.path_in_schema, c.total_compressed_size) for f in glob.glob(f"{path}/*.parquet") for c in [pq.ParquetFile(f).metadata.row_group(0).column(1)]]
    assert len(sizes) == 4 and agree(parquet.open_table(spark, path), numbers)
    plain = str(tmp_path / "plain")
    parquet.write(numbers, plain, "sorted", ["id"], files=4)
    import os

    size = lambda p: sum(os.path.getsize(f) for f in glob.glob(f"{p}/*.parquet"))
    assert 4 * 1024 <= size(path) - size(plain) <= 4 * 3000  # a filter of about 1,199 bytes, a power of two, in each file
    with pytest.raises(ConfigError):
        parquet.bloom_bytes(0, 0.01)


def test_interleaved_ranks(spark):
    from sparkloom.operators import layout

    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("a"), F.when(F.col("id") % 10 != 0, F.date_from_unix_date((F.col("id") % 50).cast("int"))).alias("d"))
    ranks = layout.ranked(df, ["a", "d"])
    assert [r.a for r in ranks.orderBy("_rank0").collect()] == list(range(1000))
    assert ranks.where("d is null").agg(F.max("_rank1")).first()[0] == 0 and ranks.select("_rank1").distinct().count() == 46
    made = spark.createDataFrame([(5, 3), (4095, 4095)], "x long, y long").select(layout.morton(["x", "y"]).alias("z")).collect()
    assert [r.z for r in made] == [0b100111, 2**24 - 1]
    wide = spark.createDataFrame([(4095,) * 4], "p long, q long, r long, s long").select(layout.morton(["p", "q", "r", "s"]).alias("z")).first().z
    assert wide == 2**48 - 1


def test_catalogue(spark, numbers, tmp_path):
    numbers.write.parquet(str(tmp_path / "facts.parquet"))
    c = Catalogue(spark)
    c.open_all(str(tmp_path), ["facts"])
    with pytest.raises(SchemaError):
        c.add("facts", str(tmp_path / "facts.parquet"))
    assert c.entry("facts").stale() and c.analyse("facts").rows == 4000 and not c.entry("facts").stale()
    numbers.limit(2000).write.mode("append").parquet(str(tmp_path / "facts.parquet"))
    c.refresh("facts")
    assert c.entry("facts").rows == 6000 and c.entry("facts").stale()
    c.save(str(tmp_path / "saved"))
    loaded = Catalogue.load(spark, str(tmp_path / "saved"))
    assert loaded.table("facts").count() == 6000 and loaded.entry("facts").statistics == c.entry("facts").statistics and loaded.entry("facts").stale()
    assert cli.main(["query", "select count(*) as n from facts_cli", "--table", f"facts_cli={tmp_path}/facts.parquet", "--json"], spark) == 0
    assert cli.main(["query", "selec", "--json"], spark) == 2
    for command in ("schema", "stats", "files"):
        assert cli.main([command, "--table", f"facts_cli={tmp_path}/facts.parquet"], spark) == 0


def test_histograms_and_estimates(numbers):
    for h in (st.equi_width(numbers, "k"), st.equi_depth(numbers, "k")):
        assert h.rows == 4000 and h.nulls == 0
        assert abs(h.estimate_range(100, 299) / numbers.where("k between 100 and 299").count() - 1) < 0.1
        assert abs(h.selectivity(-math.inf, math.inf) - 1) < 1e-9 and 2 < h.estimate_equal(500) < 6
    depth = [b.rows for b in st.equi_depth(numbers, "k").buckets]
    assert max(depth) < 2 * min(depth)
    assert abs(st.linear_count(numbers, "k") / 1000 - 1) < 0.1 and st.linear_count(numbers, "id", 64) == math.inf
    assert st.sample_count(numbers, "k", 0.5) > 1500  # the bias it is kept to show
    t = st.collect(numbers)
    assert t.columns["s"].nulls == 400 and abs(t.columns["k"].distinct / 1000 - 1) < 0.1
    assert st.either(0.5, 0.5) == 0.75 and st.both(0.5, 0.5) == 0.25 and st.group_count(t, ["s"]) == 8
    assert st.join_order(t, {"a": (t, "s"), "b": (t, "id")}) == ["b", "a"]


def test_correlation_and_runs(spark, numbers):
    twice = numbers.withColumn("w", F.col("v") * -2).withColumn("c", F.lit(1))
    assert abs(st.linear_correlation(twice, "v", "w") + 1) < 1e-9 and st.linear_correlation(twice, "v", "c") == 0
    assert st.mutual_information(twice.limit(0), "v", "w") == 0 == st.mutual_information(twice, "c", "v")
    assert tuple(st.shares(numbers, {"a": F.col("k") < 250, "b": F.col("s").isNull(), "c": ~(F.col("s") == "1")}).first()) == (0.25, 0.1, numbers.where("s <> '1'").count() / 4000)
    assert st.mutual_information(twice, "v", "w") > 0.95 > 0.2 > st.mutual_information(twice, "k", "s")
    assert st.related(twice, ["v", "w", "k"])[0][:2] == ("v", "w")
    assert st.corrected(0.3, 0.3, 1.0) == 0.3
    runs = st.run_lengths(spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", None, None, "a"])], "g int, i int, x string"), "x", ["i"], ["g"]).orderBy("run").collect()
    assert [(r.value, r.rows, r.start) for r in runs] == [("a", 2, 1), (None, 2, 3), ("a", 1, 5)]
    advice = st.encoding_advice(numbers, "k").first()
    assert advice.packed < advice.plain


def test_stage_chains_over_tables_and_streams(spark, numbers, tmp_path):
    numbers.write.parquet(str(tmp_path / "in"))
    stages = [pipeline.filter_stage(F.col("k") < 100), pipeline.project_stage(["k", "id"])]
    stream = spark.readStream.schema(numbers.schema).parquet(str(tmp_path / "in"))
    pipeline.by_batches(stream, stages, str(tmp_path / "out"), str(tmp_path / "c"))
    assert agree(spark.read.parquet(str(tmp_path / "out")), pipeline.run(numbers, stages))
    totals = [*stages, pipeline.aggregate_stage(["k"], [Aggregate("n", "count_star")])]
    pipeline.by_batches(stream, totals, str(tmp_path / "totals"), str(tmp_path / "c2"), "complete")
    assert agree(spark.read.parquet(str(tmp_path / "totals")), pipeline.run(numbers, totals))
    with pytest.raises(PlanError):
        pipeline.run(stream, [pipeline.sort_stage([SortKey("k")])])
    with pytest.raises(ConfigError):
        pipeline.Stage("x", "sideways", lambda d: d)
