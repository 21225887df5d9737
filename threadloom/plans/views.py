"""Inputs of the catalogued queries, derived from the shipped tables in Spark and in DuckDB alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import tokens as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, idx, role, text, tok of the conversations."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", "text")
    return m.withColumn("tok", T.message_tokens(F.col("role"), T.estimate(F.col("text"))))


MSG = "msg AS (SELECT conv_id AS session_id, turn AS idx, role, text, 4 + strlen(role) // 4 + strlen(text) // 4 AS tok FROM conversations)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.col("user_id").alias("session_id"), "event_type", "ts", "value", F.get_json_object("props", "$.k").alias("k"), (F.row_number().over(place) - 1).cast("bigint").alias("r"))


def tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, idx, id, name, input: a tool call for each event. One in thirteen is missing, see drop_uses."""
    return _called(_events(spark, sf_dir)).select("session_id", (F.col("r") * 2).alias("idx"), "id", "name", "input", "event_id")


def _called(e: DataFrame) -> DataFrame:
    """Events with the id, name and input of their calls."""
    k, n = F.col("k"), F.col("event_id")
    file = F.concat(F.lit("src/k"), k, F.lit(".py"))
    command = (
        F.when(n % 5 == 0, F.concat(F.lit('git commit -m "fix k'), k, F.lit('"'))).when(n % 5 == 1, "go test ./...").when(n % 5 == 2, "make build").when(n % 5 == 3, F.concat(F.lit("ls -la src/k"), k)).otherwise(F.concat(F.lit("python run.py\n--k "), k))
    )
    kind = F.col("event_type")
    pair = lambda *parts: F.create_map(*parts)
    made = F.when(kind == "click", pair(F.lit("pattern"), F.concat(F.lit("k"), k), F.lit("path"), F.concat(F.lit("src/k"), k))).when(kind == "error", pair(F.lit("command"), command)).otherwise(pair(F.lit("file_path"), file))
    name = F.when(kind == "view", "Read").when(kind == "click", "Grep").when(kind == "purchase", "Edit").when(kind == "signup", "Write").otherwise("Bash")
    return e.withColumns({"id": F.concat(F.lit("tu_"), n.cast("string")), "name": name, "input": made})


def tool_results(spark: SparkSession, sf_dir: str, **of_text: Column) -> DataFrame:
    """session_id, idx, tool_use_id, content, is_error: the answer to each call, a document's text. of_text: further columns, made of each document's text once."""
    docs = table(spark, sf_dir, "documents")
    n = docs.agg(F.count("*")).scalar()
    e = _events(spark, sf_dir).withColumn("doc_id", F.col("event_id") % n)
    texts = docs.select("doc_id", F.col("text").alias("content"), *(c.alias(k) for k, c in of_text.items()))
    return e.join(texts, "doc_id").select("session_id", (F.col("r") * 2 + 1).alias("idx"), F.concat(F.lit("tu_"), F.col("event_id").cast("string")).alias("tool_use_id"), "content", (F.col("event_type") == "error").alias("is_error"), "event_id", *of_text)


def tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tool_results, but with text_id in place of the content; answer_texts has the texts. For work that needs them last, so that only documents' texts are shuffled and not those of all answers."""
    n = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    return _events(spark, sf_dir).select("session_id", (F.col("r") * 2 + 1).alias("idx"), F.concat(F.lit("tu_"), F.col("event_id").cast("string")).alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), "event_id", (F.col("event_id") % n).alias("text_id"))


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, content."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("content"))


ACT = """
ev AS (SELECT event_id, user_id AS session_id, event_type, ts, value, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events),
uses AS (SELECT session_id, 2 * r AS idx, 'tu_' || event_id AS id, event_id,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Write' ELSE 'Bash' END AS name,
  CASE WHEN event_type NOT IN ('click', 'error') THEN 'src/k' || k || '.py' END AS file_path,
  CASE WHEN event_type = 'click' THEN 'k' || k END AS pattern, CASE WHEN event_type = 'click' THEN 'src/k' || k END AS path,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'git commit -m "fix k' || k || '"' WHEN 1 THEN 'go test ./...' WHEN 2 THEN 'make build' WHEN 3 THEN 'ls -la src/k' || k ELSE 'python run.py' || chr(10) || '--k ' || k END END AS command FROM ev),
results AS (SELECT session_id, 2 * r + 1 AS idx, 'tu_' || event_id AS tool_use_id, d.text AS content, event_type = 'error' AS is_error, event_id
  FROM ev JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents))"""
#: Keywords of a call, as one expression over `uses`.
KW_SQL = """CASE WHEN name IN ('Read', 'Edit', 'Write') THEN name || ' ' || file_path WHEN name = 'Grep' THEN 'Grep ' || pattern || ' ' || path
  ELSE 'Bash ' || CASE WHEN length(command) > 40 THEN substr(command, 1, 40) || '...' ELSE command END END"""


def drop_uses(uses: DataFrame) -> DataFrame:
    """Without the calls that leave orphans."""
    return uses.filter("event_id % 13 <> 0")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of each event: three kinds of input tokens and output, one of seven malformed, one of eleven without a total."""
    e = table(spark, sf_dir, "events")
    v = F.floor(F.abs("value") * 10).cast("bigint")
    n = F.col("event_id")
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), "ts",
        F.when(n % 7 == 0, "bad").otherwise(v.cast("string")).alias("input_tokens"),
        (v * 3 + n % 10).cast("string").alias("cache_creation_input_tokens"),
        F.when(n % 5 == 0, F.lit(None)).otherwise((v * 7).cast("string")).alias("cache_read_input_tokens"),
        (n % 100).alias("output_tokens"), (n % 11 != 0).alias("has_total"),
    )


USAGE = """usage AS (SELECT event_id, user_id AS session_id, ts, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE v::VARCHAR END AS input_tokens,
  (v * 3 + event_id % 10)::VARCHAR AS cache_creation_input_tokens, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (v * 7)::VARCHAR END AS cache_read_input_tokens,
  event_id % 100 AS output_tokens, event_id % 11 <> 0 AS has_total FROM (SELECT *, floor(abs(value) * 10)::BIGINT AS v FROM events))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, idx, role, text): the history of every request, one for each user turn.

    In conversations with id % 7 = 3 the last request's history is edited: its row 0 differs; in those with
    id % 7 = 5 it has lost its last row.
    """
    m = messages(spark, sf_dir)
    asks = m.filter("role = 'user'").select("session_id", F.col("idx").alias("upto"), F.row_number().over(W.partitionBy("session_id").orderBy("idx")).alias("seq"), F.count("*").over(W.partitionBy("session_id")).alias("n_seq"))
    h = m.join(asks, "session_id").filter("idx <= upto")
    last = (F.col("seq") == F.col("n_seq")) & (F.col("n_seq") > 1)
    text = F.when(last & (F.col("session_id") % 7 == 3) & (F.col("idx") == 0), F.concat(F.lit("edited "), F.col("text"))).otherwise(F.col("text"))
    return h.filter(~(last & (F.col("session_id") % 7 == 5) & (F.col("idx") >= F.col("upto") - 2))).select("session_id", "seq", "idx", "role", text.alias("text"))


REQ = """asks AS (SELECT session_id, idx AS upto, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS seq, count(*) OVER (PARTITION BY session_id) AS n_seq FROM msg WHERE role = 'user'),
req AS (SELECT m.session_id, seq, m.idx, m.role, CASE WHEN seq = n_seq AND n_seq > 1 AND m.session_id % 7 = 3 AND m.idx = 0 THEN 'edited ' || text ELSE text END AS text
  FROM msg m JOIN asks a ON m.session_id = a.session_id AND m.idx <= a.upto WHERE NOT (seq = n_seq AND n_seq > 1 AND m.session_id % 7 = 5 AND m.idx >= upto - 2))"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive blocks made of documents: block = doc_id, session = source, range and epoch by arithmetic."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(
        n.alias("block_id"), F.col("source").alias("session_id"), (1 + n % 4).alias("history_epoch"), ((n * 7) % 100).alias("block_range_start"), ((n * 7) % 100 + 20 + n % 13).alias("block_range_end"),
        T.estimate(F.col("text")).alias("estimated_tokens"), F.sha2("text", 256).alias("content_hash"), (n % 50).alias("created_at"), (n % 17 == 0).cast("int").alias("isolated"), F.col("text").alias("summary_text"),
    )


ARCHIVE = """archive AS (SELECT doc_id AS block_id, source AS session_id, 1 + doc_id % 4 AS history_epoch, (doc_id * 7) % 100 AS block_range_start, (doc_id * 7) % 100 + 20 + doc_id % 13 AS block_range_end,
  strlen(text) // 4 AS estimated_tokens, sha256(text) AS content_hash, doc_id % 50 AS created_at, (doc_id % 17 = 0)::INT AS isolated, text AS summary_text FROM documents)"""

#: SQL spellings of shared text rules; {0} is the text.
EDGES_SQL = """'.,;:!?"''()[]{}…—'"""


def words_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({text}), '\\s+'), lambda w: trim(w, {EDGES_SQL})), lambda w: length(w) >= 3)"


def list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def truncate_sql(text: str, most: int) -> str:
    cut = f"(substr({text}, 1, {most}) || '…')"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN len(string_split({cut}, '```')) % 2 = 0 THEN {cut} || chr(10) || '```' ELSE {cut} END"


BLOCK = "type string, text string, thinking string, signature string, id string, name string, input map<string,string>, tool_use_id string, content string, is_error boolean"


def histories(spark: SparkSession, sf_dir: str, most: int | None = None, facts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Blocks of whole histories, three rows for each event of a user: what the user says (a text of benchmark, every fourth with a task), thinking of every fourth event, words and a call of the assistant (one in thirteen has lost it), and the answer, a document.

    Of every third session the last request is still open. seq and the state of rows are those of a 300th request: early rows have been stubs
    for long, those of the third quarter for 60 requests. most: code points of documents that are shown, for work that looks at no more of them.
    facts: blocks have text_id and these facts of a document's text in place of the text; answer_texts has the texts.
    """
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n_items, n_docs = items.agg(F.count("*")).scalar(), docs.agg(F.count("*")).scalar()
    e = _called(_events(spark, sf_dir)).withColumns({"n_ev": F.count("*").over(W.partitionBy("session_id")), "item_id": F.col("event_id") % n_items, "doc_id": F.col("event_id") % n_docs, "thought_id": F.when(F.col("event_id") % 4 == 0, (F.col("event_id") * 7) % n_docs)})
    e = e.join(items.select("item_id", F.col("text").alias("said")), "item_id")
    kinds = dict(part.strip().split(" ", 1) for part in BLOCK.split(", "))
    row = lambda off, pos, role, **known: F.struct(F.lit(off).alias("off"), F.lit(pos).alias("pos"), F.lit(role).alias("role"), known.get("text_id", F.lit(None)).cast("bigint").alias("text_id"), *(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    n = F.col("event_id")
    blocks = F.array(
        row(0, 0, "user", type=F.lit("text"), text=F.concat("said", F.when(n % 4 == 1, F.concat(F.lit(" TODO: k"), "k")).otherwise(F.lit("")))),
        row(1, 0, "assistant", type=F.lit("thinking"), text_id=F.col("thought_id"), signature=F.when(n % 8 == 0, F.concat(F.lit("s"), "k"))),
        row(1, 1, "assistant", type=F.lit("text"), text=F.concat(F.lit("Next "), "event_type", F.lit(" of k"), "k", F.lit("."))),
        row(1, 2, "assistant", type=F.lit("tool_use"), id=F.col("id"), name=F.col("name"), input=F.col("input")),
        row(2, 0, "user", type=F.lit("tool_result"), tool_use_id=F.col("id"), text_id=F.col("doc_id"), is_error=F.col("event_type") == "error"),
    )
    b = e.select("session_id", "event_id", "r", "n_ev", F.inline(blocks)).filter("not (type = 'thinking' and text_id is null) and not (type = 'tool_use' and event_id % 13 = 0) and not (session_id % 3 = 0 and r = n_ev - 1 and off > 0)")
    # Documents are attached last, to the blocks that show one: their texts are shuffled once.
    text, of_text = F.substring("text", 1, most) if most else F.col("text"), () if facts is None else ("text_id", "facts")
    shown = b.filter("text_id is not null").join(docs.select(F.col("doc_id").alias("text_id"), (facts(text).alias("facts") if facts else text.alias("_text"))), "text_id")
    if facts is None:
        shown = shown.withColumns({"thinking": F.when(F.col("type") == "thinking", F.col("_text")), "content": F.when(F.col("type") == "tool_result", F.col("_text"))}).drop("_text")
    b = shown.unionByName(b.filter("text_id is null"), allowMissingColumns=True)
    idx, total = F.col("r") * 3 + F.col("off"), F.col("n_ev") * 3
    stubbed = F.when(idx * 2 < total, F.when(idx % 67 == 0, 280).otherwise(10)).when(idx * 4 < total * 3, 240)
    return b.select("session_id", idx.cast("bigint").alias("idx"), "pos", "role", *kinds, F.lit(300).alias("seq"), stubbed.alias("stubbed_at"), ((idx % 5) / F.lit(5.0)).alias("heat"), (idx % 31 == 0).alias("pinned"), *of_text)
