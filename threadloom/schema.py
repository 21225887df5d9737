"""Tables of the engine: blocks of messages in order, archives, postings, snapshots."""

from __future__ import annotations

#: A typed block of a message's content.
BLOCK = "struct<type: string, text: string, thinking: string, signature: string, id: string, name: string, input: map<string, string>, tool_use_id: string, content: string, is_error: boolean, extra: map<string, string>>"
#: One row for each message.
MESSAGE = f"session_id bigint, idx bigint, role string, content_kind string, blocks array<{BLOCK}>, extra map<string, string>"
#: One row for each block; the form in which operators work.
BLOCKS = "session_id bigint, idx bigint, pos int, role string, type string, text string, thinking string, signature string, id string, name string, input map<string, string>, tool_use_id string, content string, is_error boolean"
ARCHIVE = "block_id string, session_id string, history_epoch bigint, block_range_start bigint, block_range_end bigint, message_count bigint, estimated_tokens bigint, summary_text string, messages_json string, content_hash string, created_at string, isolated int"
KEYWORD = "block_id string, pos bigint, keyword string, source string"
KNOWN_BLOCK_KEYS = ("type", "text", "thinking", "signature", "id", "name", "input", "tool_use_id", "content", "is_error")
KNOWN_MESSAGE_KEYS = ("role", "content")
