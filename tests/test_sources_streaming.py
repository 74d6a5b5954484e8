"""Paged sources, incremental chunks, configuration, and streams against the same batch."""

import pytest
from pyspark.sql import functions as F

from quantloom.sources import paged, tables
from quantloom.streaming import bars

DATA = "/root/testdata/sf0.001"


def pages(key, start):
    rows = [[i, f"{key}{i}"] for i in range(7)]
    return rows[start : start + 3], 7


def test_paging_retries_and_guards():
    assert len(list(paged.fetch_rows(pages, "A"))) == 7
    calls, waits = [], []

    def flaky(key, start):
        calls.append(start)
        if len(calls) < 3:
            raise paged.TransientError
        return ([], None)

    assert list(paged.fetch_rows(flaky, "A", pause=waits.append)) == [] and waits == [0.5, 1.0]
    with pytest.raises(tables.EngineError, match="repeats"):
        list(paged.fetch_rows(lambda k, s: ([[1]], None), "A"))
    with pytest.raises(tables.EngineError, match="cut"):
        list(paged.fetch_rows(pages, "A", cap=5))


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    reader = spark.read.format("paged").schema("key string, i long, name string")
    df = reader.option("transport", "quantloom.sources.paged:demo_pages").option("keys", '["A", "B"]').load()
    assert df.groupBy("key").count().orderBy("key").collect() == [("A", 7), ("B", 7)]


def test_chunks_and_manifest(spark):
    m = tables.month_chunks(spark, "2024-01-15", "2024-03-10").orderBy("lo").collect()
    assert [str(r.lo) for r in m] == ["2024-01-15", "2024-02-01", "2024-03-01"] and str(m[-1].hi) == "2024-03-10"
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    plan = tables.plan_tasks(one("dataset", "candles"), one("symbol", "A", "B"), tables.month_chunks(spark, "2024-01-15", "2024-03-10"))
    done = plan.where("symbol = 'A'").withColumn("status", F.lit("ok"))
    left = tables.stale_tasks(plan, done, ["dataset", "symbol", "m_lo"], "2024-03-05")
    assert left.count() == 4


def test_ledger_cache_and_config(spark, tmp_path):
    tables.append_trial(spark.createDataFrame([(1, 2.0)], "a int, b double"), f"{tmp_path}/l")
    tables.append_trial(spark.createDataFrame([(1, "x")], "a int, c string"), f"{tmp_path}/l")
    assert set(tables.read_ledger(spark, f"{tmp_path}/l").columns) == {"a", "b", "c"}
    with pytest.raises(tables.CacheMiss):
        tables.cached(spark, f"{tmp_path}/none")
    tables.single_use(spark, f"{tmp_path}/once", spark.range(1))
    with pytest.raises(tables.EngineError):
        tables.single_use(spark, f"{tmp_path}/once", spark.range(1))
    c = tables.PullConfig.parse("# x\n```yaml\nstart: 2024-01-01\nend: 2024-02-01\ndatasets: [candles, stats]\nsymbols: [A]\npause: 1\n```")
    assert c.datasets == ("candles", "stats") and c.options == {"pause": "1"}
    with pytest.raises(tables.ConfigError, match="start.*end.*unknown|unknown"):
        tables.PullConfig.parse("```yaml\nstart: x\nend: y\ndatasets: [z]\nsymbols: []\n```")


def drain(stream, mode, name, spark):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/e")
    bars.in_name_order(spark, f"{tmp_path}/e")
    stream = bars.event_stream(spark, f"{tmp_path}/e", batch.schema, 1)
    got = drain(bars.bars(stream), "complete", "bars_out", spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bars.bars(batch).collect()))
    got = drain(bars.sessions(stream), "complete", "sessions_out", spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bars.sessions(batch).collect()))
    twice = bars.deduplicated(stream.union(stream))
    assert drain(twice, "complete", "dedup_out", spark).count() == batch.count()


def test_upsert_merges_batches_into_a_partition(spark, tmp_path):
    schema = "day string, id long, seq long, v string"
    batches = [[("a", 1, 1, "old"), ("a", 2, 1, "kept"), ("b", 1, 1, "other")], [("a", 1, 2, "new"), ("a", 3, 1, "added")], [("a", 1, 1, "late")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{k}")
        for again in range(2):  # the second time as if the batch were run again
            bars.upsert(stream, f"{tmp_path}/out", f"{tmp_path}/c{k}{again}", ["day"], ["id"], ["seq"]).awaitTermination(120)
    got = sorted((r.day, r.id, r.v) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, "new"), ("a", 2, "kept"), ("a", 3, "added"), ("b", 1, "other")]
