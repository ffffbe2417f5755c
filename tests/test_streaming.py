"""Streaming ingest against the batch read."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import read
from palimpsest.options import Options
from palimpsest.sources import carriers
from palimpsest.store import Store
from palimpsest.streaming import ingest


@pytest.fixture(scope="module")
def source(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    m = carriers.mutations(spark, data)
    for k in range(3):
        m.where(F.floor((F.col("seq") - 1) / 400) == k).coalesce(1).write.mode("append").parquet(path)
    return m, path


def stream(spark, m, path):
    return spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_runs(spark, source, tmp_path):
    m, path = source
    for _ in range(2):  # a second start finds nothing new
        ingest.ingest_runs(stream(spark, m, path), f"{tmp_path}/runs", f"{tmp_path}/check").awaitTermination()
    runs = ingest.runs(spark, f"{tmp_path}/runs")
    assert runs.count() == m.count() and runs.select("file_no").distinct().count() == 3
    assert sorted(read.scan(runs).collect()) == sorted(read.scan(m).collect())
    done = ingest.maintain(spark, f"{tmp_path}/runs", m.count())
    assert sorted(read.scan(done).collect()) == sorted(read.scan(m).collect())


def test_a_store_compacts_as_batches_come(spark, source, tmp_path):
    m, path = source
    o = Options(tier_trigger=2)
    for turn in range(2):  # a second start finds nothing new, and a batch sent again changes nothing
        s = Store(spark, o, path=f"file://{tmp_path}/store")
        ingest.ingest_store(stream(spark, m, path), s, f"{tmp_path}/check").awaitTermination()
        assert not s.ingest(m, 2) and s.last_batch == 2
        assert sorted(s.scan().collect()) == sorted(read.scan(m).collect())
        assert s.counters["compactions"] == (0 if turn else 1) and sorted(x["tier"] for x in s.live.values()) == [0, 1]
    assert s.last_sequence == m.count()


def test_latest_state(spark, source, tmp_path):
    m, path = source
    q = ingest.latest_state(stream(spark, m, path)).writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(ingest.live(spark.table("latest")).collect()) == sorted(read.scan(m).collect())
