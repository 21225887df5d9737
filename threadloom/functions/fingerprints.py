"""Canonical forms and fingerprints of JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(raw: Column) -> Column:
    """JSON with sorted keys and normal numbers; null if it isn't one JSON value."""
    return F.to_json(F.try_parse_json(raw))


def fingerprint(raw: Column) -> Column:
    """SHA-256 of the canonical form. A missing value (SQL null) and a JSON null have different ones; malformed text has that of itself."""
    return F.sha2(F.when(raw.isNull(), F.lit("missing")).otherwise(F.coalesce(canonical(raw), F.concat(F.lit("malformed:"), raw))), 256)


def session_hash(session_id: Column) -> Column:
    return F.substring(F.sha2(session_id.cast("string"), 256), 1, 16)


def is_fingerprint(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_short_hash(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{16}$"), F.lit(False))


# Block types whose cache marks don't count for a history's identity.
MARKED_TYPES = ("text", "image", "document", "tool_use", "tool_result", "thinking", "redacted_thinking")


def history_block(block: Column, input_mode: Column, role: Column) -> Column:
    """The fields of a block that identify it, as JSON; in input mode without an assistant's thinking and its signature.

    block: struct with type, text, thinking, signature, id, name, input, tool_use_id, content, is_error.
    """
    hidden = input_mode & (role == "assistant") & (block["type"] == "thinking")
    keep = lambda c: F.when(hidden, F.lit(None)).otherwise(c)
    return F.to_json(F.struct(block["type"].alias("type"), block["text"].alias("text"), keep(block["thinking"]).alias("thinking"), keep(block["signature"]).alias("signature"), block["id"].alias("id"), block["name"].alias("name"), block["input"].alias("input"), block["tool_use_id"].alias("tool_use_id"), block["content"].alias("content"), block["is_error"].alias("is_error")))


# Block types that have no use for an input.
WITHOUT_INPUT = ("text", "thinking", "tool_result")


def boundary_content(raw: Column) -> Column:
    """Canonical JSON of a message's content for a boundary's hash: blocks that have no use for an input lose a null one; all else stays, nulls too."""
    blocks = F.from_json(raw, "array<map<string,variant>>")
    kind = lambda b: F.try_variant_get(F.try_element_at(b, F.lit("type")), "$", "string")
    bare = lambda b: F.map_filter(b, lambda k, v: ~((k == "input") & kind(b).isin(*WITHOUT_INPUT) & (v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True)))))
    out = F.transform(blocks, lambda b: F.when(F.coalesce(kind(b).isin(*WITHOUT_INPUT), F.lit(False)), bare(b)).otherwise(b))
    objects = F.coalesce(F.forall(blocks, lambda b: b.isNotNull()), F.lit(False))
    return F.when(objects, F.to_json(F.to_variant_object(out))).otherwise(canonical(raw))


def history_message(role: Column, content_kind: Column, blocks: Column, input_mode: Column) -> Column:
    """SHA-256 of a message; a lone text block counts as its text, whatever the content's kind was."""
    lone = (F.size(blocks) == 1) & (F.get(blocks, F.lit(0))["type"] == "text")
    body = F.when(lone, F.to_json(F.struct(F.get(blocks, F.lit(0))["text"].alias("text")))).otherwise(F.array_join(F.transform(blocks, lambda b: history_block(b, input_mode, role)), ","))
    return F.sha2(F.concat_ws("\x1f", role, F.when(content_kind == "invalid", "invalid"), body), 256)
