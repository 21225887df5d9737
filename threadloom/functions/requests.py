"""Classification of requests by their headers and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the protocol.
SUBAGENT_MARK = r"(?i)(?:^|[\s,;])cc_is_subagent\s*=\s*true(?:$|[\s,;])"
ATTRIBUTION = "x-anthropic-billing-header:"
SDK_MARK = "cc_entrypoint=sdk-ts"
DEFAULT_LANGUAGE = "Write the title in the predominant language of the session — a stray word or code token in another language doesn't change it. Ignore the language of the examples above."
LANGUAGE_PREFIX, LANGUAGE_SUFFIX = "Write the title in ", ". Keep technical terms and code identifiers in their original form."
BLOCKED_WORDS = "add disregard forget follow generate ignore include instruction instructions instead obey output override previous prompt remove reveal system write".split()
SENSITIVE_HEADERS = ("authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization", "anthropic-api-key")


def model_family(model: Column) -> Column:
    m = F.lower(model)
    return F.when(m.contains("deepseek"), "deepseek").when(m.contains("claude") & m.contains("haiku"), "claude-haiku").when(m.contains("claude"), "claude").otherwise("unknown")


def is_subagent_mark(value: Column) -> Column:
    return F.coalesce(value.rlike(SUBAGENT_MARK), F.lit(False))


def _kind(raw: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(raw))


def agent_context(raw: Column) -> tuple[Column, Column]:
    """(type, whether a parent is named) of an agent context: missing, main, subagent, other or malformed."""
    v = F.try_parse_json(raw)
    kind = _kind(raw)
    parent_kind, type_kind = F.schema_of_variant(F.try_variant_get(v, "$.parentSessionId", "variant")), F.schema_of_variant(F.try_variant_get(v, "$.agentType", "variant"))
    parent = F.coalesce(F.trim(F.try_variant_get(v, "$.parentSessionId", "string")) != "", F.lit(False))
    bad = v.isNull() | ~kind.startswith("OBJECT") | F.coalesce(~parent_kind.isin("STRING", "VOID"), F.lit(False))
    named = F.lower(F.trim(F.try_variant_get(v, "$.agentType", "string")))
    type_ = F.when(raw.isNull(), "missing").when(bad, "malformed").when(type_kind.isNull(), "missing").when(~type_kind.isin("STRING", "VOID"), "malformed").when(named == "main", "main").when(named == "subagent", "subagent").otherwise("other")
    return type_, F.when(raw.isNull() | bad, F.lit(False)).otherwise(parent)


def system_texts(raw: Column) -> Column:
    """Texts of a system prompt given as blocks; empty for a string."""
    return F.from_json(raw, "array<struct<type:string,text:string>>")


def system_facts(raw: Column) -> tuple[Column, Column, Column]:
    """(shape, SDK mark, subagent attribution) of a system prompt: string, array, unknown or missing."""
    kind = _kind(raw)
    text = F.try_variant_get(F.try_parse_json(raw), "$", "string")
    blocks = system_texts(raw)
    shape = F.when(raw.isNull(), "missing").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").otherwise("unknown")
    sdk = F.when(shape == "string", text.contains(SDK_MARK)).when(shape == "array", F.exists(blocks, lambda b: F.coalesce(b["text"], F.lit("")).contains(SDK_MARK))).otherwise(False)
    said = lambda b: F.trim(F.coalesce(b["text"], F.lit("")))
    mark = F.when(shape == "array", F.exists(blocks, lambda b: F.coalesce(b["type"], F.lit("text")).isin("", "text") & said(b).startswith(ATTRIBUTION) & F.trim(F.substr(said(b), F.lit(len(ATTRIBUTION) + 1))).rlike(SUBAGENT_MARK))).otherwise(False)
    return shape, F.coalesce(sdk, F.lit(False)), F.coalesce(mark, F.lit(False))


def agent_role(agent_id_header: Column, billing_mark: Column, context_type: Column, parent: Column, attribution: Column) -> tuple[Column, Column]:
    """(role, reason): the first sign that makes a request a subagent's."""
    reason = (
        F.when(F.trim(F.coalesce(agent_id_header, F.lit(""))) != "", "agent_id_header").when(billing_mark, "billing_marker").when(context_type == "subagent", "agent_context_type").when(parent, "agent_context_parent").when(attribution, "system_attribution").otherwise("no_subagent_marker")
    )
    return F.when(reason == "no_subagent_marker", "main").otherwise("subagent"), reason


def is_language_request(text: Column) -> Column:
    """The default sentence, or its frame around a language: letters, blanks, hyphens and one pair of brackets, no blocked word."""
    inner = F.trim(F.substr(text, F.lit(len(LANGUAGE_PREFIX) + 1), F.length(text) - len(LANGUAGE_PREFIX) - len(LANGUAGE_SUFFIX)))
    shaped = inner.rlike(r"^[\p{L}\p{M} \-]+(\([\p{L}\p{M} \-]*\)[\p{L}\p{M} \-]*)?$|^\([\p{L}\p{M} \-]*\)[\p{L}\p{M} \-]*$") & (F.length(inner) <= 64)
    free = ~F.arrays_overlap(F.split(F.lower(inner), r"[ \-()]+"), F.array(*(F.lit(w) for w in BLOCKED_WORDS)))
    return (text == DEFAULT_LANGUAGE) | (text.startswith(LANGUAGE_PREFIX) & text.endswith(LANGUAGE_SUFFIX) & shaped & free)


def title_envelope(text: Column) -> Column:
    """Whether text is one balanced <session> element, 32 deep at most, and at most a language request after it.

    A fold over the tags in order: depth, and where the outer element was closed.
    """
    said = F.btrim(text, F.lit(" \t\n\r"))
    tags = F.regexp_extract_all(said, F.lit(r"(</?session>)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("closed"), F.lit(0).alias("deepest"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "<session>", 1).otherwise(-1)
        done = acc["closed"] > 0
        return F.struct(
            F.when(done, acc["depth"]).otherwise(depth).alias("depth"), (acc["seen"] + 1).alias("seen"), F.when(~done & (depth == 0), acc["seen"] + 1).otherwise(acc["closed"]).alias("closed"),
            F.when(done, acc["deepest"]).otherwise(F.greatest(acc["deepest"], depth)).alias("deepest"),
        )

    state = F.aggregate(tags, zero, step)
    rest = F.btrim(F.array_join(F.slice(F.split(said, "</?session>", -1), state["closed"] + 1, F.lit(1 << 20)), ""), F.lit(" \t\n\r"))
    whole = (state["closed"] > 0) & (state["closed"] == F.size(tags)) & (state["deepest"] <= 32)
    return F.coalesce(said.startswith("<session>") & whole & ((rest == "") | is_language_request(rest)), F.lit(False))


def is_title_system(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *parts: F.greatest(*(low.contains(p) for p in parts), F.lit(False))
    return F.coalesce(has("coding session", "session title") & low.contains("generate") & low.contains("title") & has("3-7 words", "sentence-case", "sentence case") & has('single "title" field', "single title field"), F.lit(False))


def output_config(raw: Column) -> Column:
    """missing, title_only (a closed JSON schema of one string field `title`) or invalid."""
    at = lambda path: F.get_json_object(raw, path)
    only = lambda path, *keys: F.coalesce(F.size(F.array_except(F.json_object_keys(at(path) if path != "$" else raw), F.array(*(F.lit(k) for k in keys)))) == 0, F.lit(False))
    s = "$.format.schema"
    ok = only("$", "effort", "format") & only("$.format", "type", "schema") & only(s, "type", "properties", "required", "additionalProperties") & only(f"{s}.properties", "title") & only(f"{s}.properties.title", "type")
    ok &= (at("$.format.type") == "json_schema") & (at(f"{s}.type") == "object") & (at(f"{s}.required") == '["title"]') & (at(f"{s}.additionalProperties") == "false") & (at(f"{s}.properties.title.type") == "string")
    return F.when(raw.isNull(), "missing").when(F.coalesce(ok, F.lit(False)), "title_only").otherwise("invalid")


def auxiliary(n_messages: Column, role: Column, user_text: Column, system_text: Column, config: Column) -> Column:
    """Why a request only asks for a session title: title_prompt_fallback, title_schema, or null."""
    title = (n_messages == 1) & (role == "user") & title_envelope(user_text) & is_title_system(system_text)
    kind = output_config(config)
    return F.when(title & (kind == "missing"), "title_prompt_fallback").when(title & (kind == "title_only"), "title_schema")


def block_texts(raw: Column) -> Column:
    """The text of a string, or of blocks that are all text, line by line; null for anything else."""
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    kind = _kind(raw)
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(raw), "$", "string")).when(kind.startswith("ARRAY") & (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False))), joined)


def session_id(header: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(header), F.lit("")), F.uuid())


def redacted_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SENSITIVE_HEADERS), "[REDACTED]").otherwise(v))
