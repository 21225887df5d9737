"""Event streams of responses as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import usage as U


def event_rows(streams: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data, type, fields) of (stream_id, text): events between blank lines, the last one with or without its blank line."""
    parts = F.filter(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n\n", -1), lambda e: F.trim(e) != "")
    e = streams.select("stream_id", F.posexplode(parts).alias("seq", "raw"))
    return event_columns(e)


def event_columns(e: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data, type, fields) of events as text (stream_id, seq, raw)."""
    # Up to the last character of the line that is no space: found from the line's end, without a try at each of its characters.
    line = lambda name: F.regexp_extract("raw", rf"(?m)^{name}:\s*((?:.*[^\s\u0085\u2028\u2029])?)\s*$", 1)
    count = lambda name: F.size(F.split("raw", rf"(?m)^{name}:", -1)) - 1
    e = e.select("stream_id", "seq", line("event").alias("event"), line("data").alias("data"), (count("event") * 100 + count("data")).alias("fields"))
    return e.select("stream_id", "seq", "event", "data", F.get_json_object("data", "$.type").alias("type"), "fields")


def event_facts(events: DataFrame) -> DataFrame:
    """Events with what a stream's life depends on: start, stop, bad (a start or stop that is not well formed), actual (a start's input tokens)."""
    part = F.col("event").isin("message_start", "message_stop") | F.coalesce(F.col("type").isin("message_start", "message_stop"), F.lit(False))
    use = {k: F.get_json_object("data", f"$.message.usage.{k}") for k in U.INPUTS}
    start, stop = F.coalesce(F.col("type") == "message_start", F.lit(False)), F.coalesce(F.col("type") == "message_stop", F.lit(False))
    e = events.withColumns({"start": start, "stop": stop, "actual": F.when(start, U.strict_total(F.get_json_object("data", "$.message.type"), use))})
    bad = part & (F.coalesce(F.col("event") != F.col("type"), F.lit(True)) | (F.col("fields") != 101) | (F.col("start") & F.col("actual").isNull()))
    return e.withColumn("bad", F.coalesce(bad, F.lit(False)))


def lifecycles(events: DataFrame) -> DataFrame:
    """(stream_id, complete, actual): a stream counts if it has one start with valid usage, then one stop, both named as their data say."""
    g = event_facts(events).groupBy("stream_id").agg(
        F.count_if("start").alias("starts"), F.count_if("stop").alias("stops"), F.min(F.when(F.col("start"), F.col("seq"))).alias("first"), F.max(F.when(F.col("stop"), F.col("seq"))).alias("last"), F.bool_or("bad").alias("bad"), F.max("actual").alias("actual")
    )
    ok = (F.col("starts") == 1) & (F.col("stops") == 1) & (F.col("first") < F.col("last")) & ~F.col("bad")
    return g.select("stream_id", F.coalesce(ok, F.lit(False)).alias("complete"), F.when(ok, F.col("actual")).alias("actual"))


OBJECT = "map<string,variant>"


def _number(value: Column) -> Column:
    """A variant's number; null for anything else."""
    return F.when(F.schema_of_variant(value).rlike(r"^(BIGINT$|DOUBLE$|FLOAT$|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def _json_number(value: Column) -> Column:
    """A number as JSON, without a fraction if it has none."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often `of` names it: Spark shares no expressions inside of lambdas."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def scaled_usage(usage: Column, factor: float) -> Column:
    """A usage object (a map of variants) with positive input fields times the factor, rounded down, and its total, if there is one, made anew from them and the output."""
    if factor >= 1:
        return usage
    field = lambda u, k: _number(F.try_element_at(u, F.lit(k)))

    def made(u: Column, n: Column) -> Column:
        """The object, of its numbers."""
        put = {k: F.when(n[k] > 0, F.floor(n[k] * factor).cast("double")) for k in U.INPUTS}
        total = F.coalesce(n["output_tokens"], F.lit(0.0))
        for c in put.values():
            total = total + F.coalesce(c, F.lit(0.0))

        def fresh(k: Column) -> Column:
            value = F.when(k == "total_tokens", total)
            for name, c in put.items():
                value = value.when(k == name, c)
            return value

        return F.transform_values(u, lambda k, v: F.when(k.isin("total_tokens", *U.INPUTS), F.coalesce(_once(fresh(k), lambda x: F.parse_json(_json_number(x))), v)).otherwise(v))

    return _once(usage, lambda u: _once(F.struct(*(field(u, k).alias(k) for k in (*U.INPUTS, "output_tokens"))), lambda n: made(u, n)))


def scaled_events(events: DataFrame, factor: float) -> DataFrame:
    """Events with scaled usage in message_start; in message_delta the usage loses its input fields first. All else in their data stays.

    Rewritten data are compact JSON with the names of an object in order; data without a usage object, and what is
    no JSON object, stay as they are, byte for byte.
    """
    def put(whole: Column, name: str, value: Column) -> Column:
        return F.transform_values(whole, lambda k, v: F.when(k == name, value).otherwise(v))

    def inner(whole: Column, name: str) -> Column:
        return _once(F.try_element_at(whole, F.lit(name)), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", OBJECT)))

    e = events.withColumn("_whole", F.when(F.col("type").isin("message_start", "message_delta"), F.from_json("data", OBJECT)))
    e = e.withColumn("_message", F.when(F.col("type") == "message_start", inner(F.col("_whole"), "message")))
    # What is scaled: of a start its message's usage, of a delta its own without input fields.
    own = inner(F.when(F.col("type") == "message_delta", F.col("_whole")), "usage")
    e = e.withColumn("_usage", F.coalesce(inner(F.col("_message"), "usage"), F.map_filter(own, lambda k, v: ~k.isin(*U.INPUTS))))
    e = e.withColumn("_usage", F.to_variant_object(scaled_usage(F.col("_usage"), factor)))
    started = put(F.col("_whole"), "message", F.to_variant_object(put(F.col("_message"), "usage", F.col("_usage"))))
    fresh = F.when(F.col("_usage").isNotNull(), F.to_json(F.to_variant_object(F.when(F.col("type") == "message_start", started).otherwise(put(F.col("_whole"), "usage", F.col("_usage"))))))
    return e.withColumn("data", F.coalesce(fresh, "data")).drop("_whole", "_message", "_usage")


def scaled_answers(answers: DataFrame, factor: float) -> DataFrame:
    """Answers (status, body) that came in one piece: body with scaled usage, and actual, the input tokens that a baseline can be made of.

    A body of a status from 200 to 299 that is a JSON object is written anew, compact and with the names of objects in
    order, whether or not it has a usage object; all others stay as they are, byte for byte, and have no actual.
    actual is null unless the body is a message with well-formed usage.
    """
    good = F.col("status").between(200, 299) & F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    a = answers.withColumn("_whole", F.when(good, F.from_json("body", OBJECT)))
    use = {k: F.get_json_object("body", f"$.usage.{k}") for k in U.INPUTS}
    usage = _once(F.try_element_at("_whole", F.lit("usage")), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", OBJECT)))
    a = a.withColumn("_usage", usage).withColumn("_usage", F.to_variant_object(scaled_usage(F.col("_usage"), factor)))
    whole = F.transform_values("_whole", lambda k, v: F.when((k == "usage") & F.col("_usage").isNotNull(), F.col("_usage")).otherwise(v))
    a = a.withColumn("actual", F.when(F.col("_whole").isNotNull(), U.strict_total(F.get_json_object("body", "$.type"), use)))
    return a.withColumn("body", F.coalesce(F.to_json(F.to_variant_object(whole)), "body")).drop("_whole", "_usage")


def baseline_changes(lifecycles_: DataFrame, requests: DataFrame) -> DataFrame:
    """Complete streams beside their requests, the last of each session and epoch first."""
    order = W.partitionBy("session_id", "epoch").orderBy(F.desc("generation"))
    return lifecycles_.filter("complete").join(requests, "stream_id").withColumn("newest", F.row_number().over(order) == 1)
