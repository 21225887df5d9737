"""Stateful operators on streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import continuity as C
from threadloom.plans import views
from threadloom.streaming import sessions as S


def streamed(spark, df, processor, schema, path, name):
    """df in two files, read one file a batch."""
    df.filter("seq <= 2").coalesce(1).write.mode("append").parquet(path)
    df.filter("seq > 2").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    q = S.with_state(stream, processor, schema).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_epochs(spark, sf, tmp_path, few_partitions):
    h = C.histories(views.requests(spark, sf))
    got = streamed(spark, h, S.Epochs(), S.EPOCH_ROWS, str(tmp_path / "in"), "epochs_out")
    want = C.epochs(h)
    key = lambda df: sorted(tuple(r) for r in df.select("session_id", "seq", "epoch", "common_prefix", "reason").collect())
    assert key(got) == key(want)


def test_compared():
    assert S.compared(["a"], None, 0) == (1, 0, "initial")
    assert S.compared(["a", "b"], ["a"], 1) == (1, 1, "appended")
    assert S.compared(["a"], ["a"], 1) == (1, 1, "unchanged")
    assert S.compared(["a"], ["a", "b"], 1) == (2, 1, "history_shrunk")
    assert S.compared(["x", "b"], ["a", "b"], 2) == (3, 0, "history_changed")
    assert S.compared(None, ["a"], 3) == (4, 0, "invalid_history")


def test_sticky(spark, tmp_path, few_partitions):
    rows = [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "a", 3)]
    df = spark.createDataFrame(rows, "session_id bigint, tool_use_id string, seq bigint")
    got = streamed(spark, df, S.Sticky(), S.STICKY_ROWS, str(tmp_path / "in"), "sticky_out")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1, 1), (1, "a", 3, 1), (1, "b", 2, 2), (2, "a", 3, 3)]


def test_snapshots(spark, tmp_path, few_partitions):
    rows = [(1, 1, "store", ["a", "b"]), (1, 3, "get", ["a", "b", "c"]), (1, 4, "get", ["x", "b", "c"]), (2, 3, "get", ["a"])]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, kind string, hashes array<string>")
    got = streamed(spark, df, S.Snapshots(3_600_000), S.SNAPSHOT_ROWS, str(tmp_path / "in"), "snap_out")
    assert sorted((r.session_id, r.seq, r.usable) for r in got.collect()) == [(1, 1, True), (1, 3, True), (1, 4, False), (2, 3, False)]


def test_triggers(spark, tmp_path, few_partitions):
    import datetime as dt

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, k, k, at + dt.timedelta(minutes=m), s) for k, (m, s) in enumerate([(0, 100), (1, 700), (9, 700), (10, 1200), (11, 20000)], 1)]
    df = spark.createDataFrame(rows, "session_id bigint, request_id bigint, seq bigint, ts timestamp, selected bigint")
    got = streamed(spark, df, S.Triggers(1000, 240), S.TRIGGER_ROWS, str(tmp_path / "in"), "trig_out")
    want = C.triggers(df, 1000, 240).select("request_id", "trigger")
    assert {r.request_id: r.trigger for r in got.collect()} == {r.request_id: r.trigger for r in want.collect()} == {1: "none", 2: "none", 3: "pause", 4: "tokens", 5: "emergency"}


def test_baselines(spark, tmp_path, few_partitions):
    df = spark.createDataFrame([(1, 1, 5, 10), (1, 3, 4, 20), (1, 4, 6, 30)], "session_id bigint, seq bigint, generation bigint, actual bigint")
    got = streamed(spark, df, S.Baselines(), S.BASELINE_ROWS, str(tmp_path / "in"), "base_out")
    assert {r.generation: r.accepted for r in got.collect()} == {5: True, 4: False, 6: True}
    assert C.baselines(df.withColumn("epoch", F.lit(1)).drop("seq")).first().actual == 30
