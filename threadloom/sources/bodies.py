"""Request bodies as tables: open JSON to messages and typed blocks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import EngineConfig
from threadloom.schema import KNOWN_BLOCK_KEYS, KNOWN_MESSAGE_KEYS

RAW = "map<string,string>"


OPEN = "map<string,variant>"


def raw_values(opened: Column) -> Column:
    """A map of variants as a map of JSON texts: strings keep their quotes, a JSON null is the text null."""
    return F.transform_values(opened, lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def fields(raw: Column) -> Column:
    """The fields of a JSON object, each as JSON text; null for anything else."""
    return F.when(_is_kind(raw, "OBJECT"), raw_values(F.from_json(raw, OPEN)))


def _is_kind(raw: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith(kind), F.lit(False))


BLOCK_JSON = "struct<type:string,text:string,thinking:string,signature:string,id:string,name:string,input:map<string,string>,tool_use_id:string,content:string,is_error:boolean>"


def blocks_of(raw: Column) -> Column:
    """An array of blocks with what isn't known of each in `extra`."""
    typed, whole = F.from_json(raw, f"array<{BLOCK_JSON}>"), F.from_json(raw, f"array<{OPEN}>")
    known = F.array(*(F.lit(k) for k in KNOWN_BLOCK_KEYS))
    extra = F.transform(whole, lambda m: raw_values(F.map_filter(m, lambda k, _: ~F.array_contains(known, k))))
    return F.zip_with(typed, extra, lambda b, e: F.struct(*(b[k].alias(k) for k in KNOWN_BLOCK_KEYS), e.alias("extra")))


def text_block(text: Column) -> Column:
    none = F.lit(None).cast("string")
    parts = {k: none for k in KNOWN_BLOCK_KEYS} | {"type": F.lit("text"), "text": text, "input": F.lit(None).cast(RAW), "is_error": F.lit(None).cast("boolean")}
    return F.struct(*(parts[k].alias(k) for k in KNOWN_BLOCK_KEYS), F.create_map().cast(RAW).alias("extra"))


def parse_content(raw: Column) -> tuple[Column, Column]:
    """(kind, blocks) of a message's content: a string is one text block, malformed content an empty one, missing content none."""
    string, array = _is_kind(raw, "STRING"), _is_kind(raw, "ARRAY")
    kind = F.when(F.coalesce(raw, F.lit("")) == "", "empty").when(string, "string").when(array, "array").otherwise("invalid")
    said = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    blocks = F.when(kind == "string", F.array(text_block(said))).when(kind == "array", blocks_of(raw)).when(kind == "invalid", F.array(text_block(F.lit(""))))
    return kind, F.coalesce(blocks, F.slice(F.array(text_block(F.lit(""))), 1, 0))


def rebuild_content(kind: Column, blocks: Column) -> Column:
    """JSON of blocks: a lone text block of a string is a string again; empty thinking goes, a call's missing input is {}, unknown fields come last."""
    kept = F.filter(blocks, lambda b: ~((b["type"] == "thinking") & (F.coalesce(b["thinking"], F.lit("")) == "")))
    known = lambda b: F.to_json(F.struct(*(F.when((b["type"] == "tool_use") & b["input"].isNull(), F.create_map().cast(RAW)).otherwise(b["input"]).alias(k) if k == "input" else b[k].alias(k) for k in KNOWN_BLOCK_KEYS)))
    quoted = lambda s: F.substr(F.to_json(F.array(s)), F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    more = lambda b: F.transform(F.map_entries(b["extra"]), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    whole = lambda b: F.when(F.size(b["extra"]) > 0, F.concat(F.regexp_replace(known(b), r"\}$", F.when(known(b) == "{}", "").otherwise(",")), F.array_join(more(b), ","), F.lit("}"))).otherwise(known(b))
    body = F.transform(kept, whole)
    text = F.to_json(F.array(F.get(kept, F.lit(0))["text"]))
    lone = (kind == "string") & (F.size(kept) == 1)
    return F.when(lone, F.substr(text, F.lit(2), F.length(text) - 2)).otherwise(F.concat(F.lit("["), F.array_join(body, ","), F.lit("]")))


def probes(body: Column) -> tuple[Column, Column, Column]:
    """(model, number of messages, whether streamed) with unknown, 0 and false where the body doesn't say."""
    return F.coalesce(F.get_json_object(body, "$.model"), F.lit("unknown")), F.coalesce(F.json_array_length(F.get_json_object(body, "$.messages")), F.lit(0)), F.coalesce(F.get_json_object(body, "$.stream") == "true", F.lit(False))


def usable(requests: DataFrame, config: EngineConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable, passed through) requests: bodies that are small enough JSON objects with an array of messages, and the rest."""
    most = (config or EngineConfig()).max_body_bytes
    ok = (F.octet_length("body") <= most) & _is_kind(F.col("body"), "OBJECT") & _is_kind(F.get_json_object("body", "$.messages"), "ARRAY")
    ok = F.coalesce(ok, F.lit(False))
    return requests.filter(ok), requests.filter(~ok)


def message_rows(requests: DataFrame) -> DataFrame:
    """(session_id, request_id, idx, role, content_kind, blocks, extra) of requests (session_id, request_id, body)."""
    raw = F.from_json(F.get_json_object("body", "$.messages"), f"array<{OPEN}>")
    m = requests.select("session_id", "request_id", F.posexplode(raw).alias("idx", "m"))
    kind, blocks = parse_content(F.to_json(F.col("m")["content"]))
    known = F.array(*(F.lit(k) for k in KNOWN_MESSAGE_KEYS))
    return m.select("session_id", "request_id", F.col("idx").cast("bigint").alias("idx"), F.try_variant_get(F.col("m")["role"], "$", "string").alias("role"), kind.alias("content_kind"), blocks.alias("blocks"), raw_values(F.map_filter("m", lambda k, _: ~F.array_contains(known, k))).alias("extra"))


def block_rows(messages: DataFrame) -> DataFrame:
    """A row for each block, with its position."""
    return messages.select("session_id", "request_id", "idx", "role", F.posexplode("blocks").alias("pos", "b")).select("session_id", "request_id", "idx", "role", "pos", "b.*")


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Requests from files of JSON lines {session_id, request_id, ts, body}; a growing folder with stream."""
    schema = "session_id string, request_id bigint, ts timestamp, body string"
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as JSON, a folder for each session, run and stage; what is there is never written again."""
    facts.write.partitionBy("session_hash", "run_id", "stage").mode("errorifexists").json(path)
