"""Usage is scaled with every number read once, and events are dealt to many tasks before they are worked on."""

from pyspark.sql import functions as F

from threadloom.plans import state
from threadloom.sources import events as E


def test_numbers_are_read_once(spark):
    assert str(E.scaled_usage(F.col("usage"), 0.5)).count("schema_of_variant") == 4


def test_events_are_dealt(spark, sf):
    for frame in (state.streams(spark, sf), state.answers(spark, sf)):
        assert "REPARTITION" in frame._jdf.queryExecution().executedPlan().toString()


def test_lines_end_where_they_did(spark):
    raws = ["event: a \ndata: {\"type\": 1}  ", "data:\nevent: x\t", "data: a b \nevent:", "data:  \nevent: \u0085", "data:  \n", "x\ndata: y\rz \x0b", "event:é  é \n\ndata:"]
    e = spark.createDataFrame([(i, 0, r) for i, r in enumerate(raws)], "stream_id int, seq int, raw string")
    got = {r.stream_id: (r.event, r.data) for r in E.event_columns(e).collect()}
    lazy = lambda name: F.regexp_extract("raw", rf"(?m)^{name}:\s*(.*?)\s*$", 1)
    assert got == {r.stream_id: (r.a, r.b) for r in e.select("stream_id", lazy("event").alias("a"), lazy("data").alias("b")).collect()}


def test_odd_usage(spark):
    datas = ['{"type":"message_start","message":{"usage":{"input_tokens":9,"output_tokens":"x","total_tokens":3,"z":[1]}}}', '{"type":"message_delta","usage":{"input_tokens":9,"output_tokens":4,"total_tokens":1.5}}', '{"type":"message_start","message":{"usage":null}}', '{"type":"message_delta","usage":{}}', '{"type":"message_start","usage":{"input_tokens":5}}', '{"type":"message_delta","message":{"usage":{"input_tokens":5}}}', '{"type":"message_start","message":{"usage":{"input_tokens":-3,"cache_read_input_tokens":2.5,"total_tokens":null}}}']
    e = spark.createDataFrame([(i, d) for i, d in enumerate(datas)], "i int, data string").withColumn("type", F.get_json_object("data", "$.type"))
    got = [r.data for r in E.scaled_events(e, 0.5).orderBy("i").collect()]
    assert got[0] == '{"message":{"usage":{"input_tokens":4,"output_tokens":"x","total_tokens":4,"z":[1]}},"type":"message_start"}'
    assert got[1] == '{"type":"message_delta","usage":{"output_tokens":4,"total_tokens":4}}'
    assert got[2] == datas[2] and got[4:6] == datas[4:6]
    assert got[3] == '{"type":"message_delta","usage":{}}'
    assert got[6] == '{"message":{"usage":{"cache_read_input_tokens":1,"input_tokens":-3,"total_tokens":1}},"type":"message_start"}'
