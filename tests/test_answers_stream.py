"""Streams of answers: lives that timers end, and answers met with requests, late and lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.plans.state import streams
from threadloom.sources.events import event_rows, lifecycles, scaled_answers
from threadloom.streaming import answers as A
from threadloom.streaming import sessions as S

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def source(spark, frames, path):
    """Frames as files that a stream reads one by one."""
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def result(spark, out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_lives(spark, sf, tmp_path, few_partitions):
    """As the batch operator gives them; streams come in two parts, and the ones without an end leave by their timers."""
    events = event_rows(streams(spark, sf)).filter("stream_id < 240")
    at = lambda i, k: F.timestamp_millis(F.lit(int(T0.timestamp() * 1000)) + i * 100 + k * 10)
    rows = events.withColumn("ts", at(F.col("stream_id"), F.col("seq"))).cache()
    last = rows.limit(1).withColumn("stream_id", F.lit(-1).cast("bigint")).withColumn("ts", F.lit(T0 + dt.timedelta(hours=5)))
    stream = source(spark, [rows.filter("seq = 0"), rows.filter("seq > 0"), last], str(tmp_path / "in"))
    got = {r.stream_id: (r.complete, r.actual) for r in result(spark, A.streamed_lifecycles(stream), "lives").collect()}
    assert got == {r.stream_id: (r.complete, r.actual) for r in lifecycles(events).collect()}
    assert len(got) == 240 and sum(c for c, _ in got.values()) == 40


def test_answers_meet_requests(spark, tmp_path, few_partitions):
    """An answer in time is met, one too late and one lost leave their requests alone; what is met goes on to the baselines."""
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    asks = [(k, at(k), 1, k, 100 * k) for k in (1, 2, 3, 4)]
    late = [(99, at(900), 9, 99, 0)]
    ends = [(1, at(3), True, 150), (4, at(9), True, 500), (2, at(200), True, 260), (77, at(4), True, 1)]
    r_schema, a_schema = "stream_id bigint, asked timestamp, session_id bigint, generation bigint, selected bigint", "stream_id bigint, ended timestamp, complete boolean, actual bigint"
    r = source(spark, [spark.createDataFrame(x, r_schema) for x in (asks, late)], str(tmp_path / "r"))
    a = source(spark, [spark.createDataFrame(x, a_schema) for x in (ends, [(98, at(900), True, 1)], [(98, at(901), True, 1)])], str(tmp_path / "a"))
    got = {x.stream_id: (x.complete, x.actual, x.minus) for x in result(spark, A.answered(r, a), "met").collect()}
    assert got == {1: (True, 150, 50), 4: (True, 500, 100), 2: (None, None, None), 3: (None, None, None)}


def test_late_answers_change_no_baseline(spark, tmp_path, few_partitions):
    met = [(1, 4, 500), (1, 1, 150), (1, 5, 700)]
    stream = source(spark, [spark.createDataFrame([x], "session_id bigint, generation bigint, actual bigint") for x in met], str(tmp_path / "b"))
    got = {x.generation: x.accepted for x in result(spark, S.with_state(stream, S.Baselines(), S.BASELINE_ROWS), "bases").collect()}
    assert got == {4: True, 1: False, 5: True}


def test_whole_answers(spark):
    rows = [(200, '{"usage":{"input_tokens":9,"total_tokens":1,"output_tokens":2},"type":"message","b":{"z":1,"a":"x"}}'), (404, '{"usage":{"input_tokens":9}}'), (200, "[1]"), (200, "no"), (200, None), (200, '{"b":1,"a":null}'), (204, '{"usage":3,"type":"message"}')]
    got = [tuple(r) for r in scaled_answers(spark.createDataFrame(rows, "status int, body string").coalesce(1), 0.5).select("body", "actual").collect()]
    assert got == [('{"b":{"a":"x","z":1},"type":"message","usage":{"input_tokens":4,"output_tokens":2,"total_tokens":6}}', 9), (rows[1][1], None), ("[1]", None), ("no", None), (None, None), ('{"a":null,"b":1}', None), ('{"type":"message","usage":3}', None)]
