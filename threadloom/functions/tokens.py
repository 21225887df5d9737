"""Token estimates and other arithmetic."""

from __future__ import annotations

import base64
import binascii

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MESSAGE_OVERHEAD = 4
MOST = 9223372036854775807


def estimate(text: Column) -> Column:
    """UTF-8 bytes over 4, rounded down; null is 0."""
    return F.coalesce(F.floor(F.octet_length(text) / 4).cast("bigint"), F.lit(0).cast("bigint"))


def message_tokens(role: Column, content_tokens: Column) -> Column:
    return F.lit(MESSAGE_OVERHEAD) + estimate(role) + content_tokens


def block_tokens(type_: Column, text: Column, thinking: Column, name: Column, input_: Column, content: Column) -> Column:
    """By the block's type: its text, thinking, name and input as JSON, or content."""
    return (
        F.when(type_ == "text", estimate(text))
        .when(type_ == "thinking", estimate(thinking))
        .when(type_ == "tool_use", estimate(name) + estimate(F.to_json(input_)))
        .when(type_ == "tool_result", estimate(content))
        .otherwise(F.lit(0).cast("bigint"))
    )


def visual_tokens(width: Column, height: Column) -> Column:
    """Tiles of 28 by 28 pixels; null for sizes that are not positive or give more than 8192."""
    n = F.ceil(width / 28) * F.ceil(height / 28)
    return F.when((width > 0) & (height > 0) & (n <= 8192), n)


def payload_fallback(characters: Column) -> Column:
    """For media of unknown size: 3/32 of the characters, 32 to 8192."""
    return F.least(F.greatest(F.floor(characters * 3 / 32), F.lit(32)), F.lit(8192)).cast("bigint")


def png_size(data: Column) -> Column:
    """(width, height) from the head of base64 PNG data, or null."""
    head = F.hex(F.unbase64(F.substring(data, 1, 32)))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("bigint")
    return F.when(F.substring(head, 1, 16) == "89504E470D0A1A0A", F.struct(number(33).alias("width"), number(41).alias("height")))


def gif_size(data: Column) -> Column:
    """(width, height) from the head of base64 GIF data, or null."""
    head = F.hex(F.unbase64(F.substring(data, 1, 16)))
    number = lambda at: F.conv(F.concat(F.substring(head, at + 2, 2), F.substring(head, at, 2)), 16, 10).cast("bigint")
    return F.when(F.substring(head, 1, 8) == "47494638", F.struct(number(13).alias("width"), number(17).alias("height")))


def webp_size(data: Column) -> Column:
    """(width, height) from the head of base64 WebP data of its three kinds, or null."""
    head = F.hex(F.unbase64(F.substring(data, 1, 40)))
    low = lambda at, n: F.conv(F.concat(*(F.substring(head, at + 2 * k, 2) for k in reversed(range(n)))), 16, 10).cast("bigint")
    kind = F.substring(head, 25, 8)
    bits = low(43, 4)
    extended = F.struct((low(49, 3) + 1).alias("width"), (low(55, 3) + 1).alias("height"))
    lossy = F.struct((low(53, 2) % 16384).alias("width"), (low(57, 2) % 16384).alias("height"))
    lossless = F.struct((bits % 16384 + 1).alias("width"), (F.floor(bits / 16384) % 16384 + 1).alias("height"))
    webp = (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.when(webp & (kind == "56503858"), extended).when(webp & (kind == "56503820") & (F.substring(head, 47, 6) == "9D012A"), lossy).when(webp & (kind == "5650384C") & (F.substring(head, 41, 2) == "2F"), lossless)


#: Base64 characters of a JPEG in which its frame header is looked for.
JPEG_HEAD = 87_384


def jpeg_size(data: Column) -> Column:
    """(width, height) from the frame header of base64 JPEG data, or null; segments before it are walked in Arrow batches."""
    @arrow_udf("struct<width: bigint, height: bigint>")
    def read(column: pa.Array) -> pa.Array:
        return pa.array([frame_size(x.as_py()) for x in column], pa.struct([("width", pa.int64()), ("height", pa.int64())]))

    return read(F.substring(data, 1, JPEG_HEAD))


def frame_size(data: str | None) -> dict[str, int] | None:
    """Width and height that the first start-of-frame segment gives."""
    try:
        raw = base64.b64decode((data or "")[: len(data or "") // 4 * 4])
    except binascii.Error:
        return None
    if raw[:2] != b"\xff\xd8":
        return None
    at = 2
    while (at := raw.find(b"\xff", at)) >= 0:
        while at < len(raw) and raw[at] == 0xFF:
            at += 1
        if at + 3 > len(raw):
            return None
        marker, at = raw[at], at + 1
        if marker in (0xD8, 0xD9) or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(raw[at : at + 2], "big")
        if size < 2 or at + size > len(raw):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and size >= 7:
            return {"height": int.from_bytes(raw[at + 3 : at + 5], "big"), "width": int.from_bytes(raw[at + 5 : at + 7], "big")}
        at += size
    return None


def image_tokens(data: Column, media_type: Column | None = None) -> Column:
    """Tokens of base64 data by the size in its head; with a media type JPEG is read too."""
    size = F.coalesce(png_size(data), gif_size(data), webp_size(data))
    if media_type is not None:
        size = F.coalesce(size, F.when(media_type == "image/jpeg", jpeg_size(data)))
    return F.coalesce(visual_tokens(size["width"], size["height"]), payload_fallback(F.length(data)))


def source_tokens(kind: Column, data: Column, media_type: Column | None = None) -> Column:
    """Tokens of an image or document block by its source: base64 data by its size, any other source 32."""
    return F.when(F.coalesce(kind == "base64", F.lit(False)) & (F.coalesce(data, F.lit("")) != ""), image_tokens(data, media_type)).otherwise(F.lit(32).cast("bigint"))


def saturating_add(a: Column, b: Column) -> Column:
    """The sum, or the nearest 64-bit number."""
    return F.coalesce(F.try_add(a.cast("bigint"), b.cast("bigint")), F.when(a > 0, F.lit(MOST)).otherwise(F.lit(-MOST - 1)))


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a.cast("bigint"), b.cast("bigint")), F.when(a > 0, F.lit(MOST)).otherwise(F.lit(-MOST - 1)))


def budget(threshold: Column) -> dict[str, Column]:
    """Shares of a threshold: 2, 3, 25 and 30 percent, each rounded down, and what is left."""
    share = lambda p: F.floor(threshold * p / 100).cast("bigint")
    parts = {"narrative": share(2), "retrieval": share(3), "re_expansion": share(25), "fresh": share(30)}
    return parts | {"stub": threshold - parts["retrieval"] - parts["narrative"] - parts["re_expansion"] - parts["fresh"]}


def approximate(n: Column) -> Column:
    """999, 1k, 1.5k: thousands with one decimal, rounded down, none if it is 0."""
    whole, tenth = F.floor(n / 1000).cast("string"), F.floor((n % 1000) / 100)
    return F.when(n < 1000, n.cast("string")).when(tenth == 0, F.concat(whole, F.lit("k"))).otherwise(F.concat(whole, F.lit("."), tenth.cast("string"), F.lit("k")))


def stage_bounds(length: Column, pressure: Column) -> tuple[Column, Column, Column]:
    """Ages at which a message leaves each stage; low pressure stretches them up to four times."""
    stretch = F.when(pressure < 2.5, F.greatest(F.least(1 + (2.5 - pressure) / 0.75, F.lit(4.0)), F.lit(1.0))).otherwise(F.lit(1.0))
    pick = lambda a, b, c: (F.when(length < 500, a).when(length < 2000, b).otherwise(c) * stretch).cast("bigint")
    return pick(5, 5, 4), pick(15, 12, 10), pick(50, 40, 30)


def stage(age: Column, intensity: Column, pinned: Column, length: Column, pressure: Column) -> Column:
    """0 to 3 by age since it was stubbed (null: 0); intensity and pinned paths put it off."""
    boost = F.floor(intensity * 20) + F.when(pinned, 30).otherwise(0)
    first, second, third = stage_bounds(length, pressure)
    return F.when(age.isNull() | (age < first + boost), 0).when(age < second + boost, 1).when(age < third + boost, 2).otherwise(3)


def intensity(errors: Column, tool_uses: Column, last_user_length: Column) -> Column:
    """0 to 1: errors, many tool calls and a long request among the last messages."""
    return F.least(F.lit(1.0), errors * F.lit(0.15) + F.when(tool_uses > 5, 0.2).otherwise(0.0) + F.when(last_user_length > 500, 0.15).otherwise(0.0))


def cache_gap_seconds(ttl: Column) -> Column:
    """The pause after which a cache of that time to live counts as gone: 61 or 4 minutes."""
    return F.when(ttl == "1h", 61 * 60).otherwise(4 * 60)


def snapshot_ttl_seconds(ttl: Column) -> Column:
    """How long a frozen prefix is kept: 65 or 30 minutes."""
    return F.when(ttl == "1h", 65 * 60).otherwise(30 * 60)


def spent_in_order(costs: Column, limit: Column) -> Column:
    """Which of an array of costs fit one after another into a limit; one that doesn't is passed over."""
    zero = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, c: Column) -> Column:
        ok = (c >= 0) & (acc["spent"] + c <= limit)
        return F.struct(F.when(ok, acc["spent"] + c).otherwise(acc["spent"]).cast("bigint").alias("spent"), F.concat(acc["fits"], F.array(ok)).alias("fits"))

    return F.aggregate(costs, zero, step, lambda acc: acc["fits"])


def bpe_tokens(text: Column, vocabulary: str, pattern: str) -> Column:
    """Exact byte-pair tokens with a rank file; null text has none. Needs the tiktoken package on the executors."""
    @arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        import tiktoken

        if vocabulary not in _ENCODERS:
            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _ENCODERS[vocabulary] = tiktoken.Encoding(name="own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[vocabulary].encode_ordinary
        return pa.array([len(encode(x.as_py())) if x.is_valid else 0 for x in column], pa.int64())

    return count(text)


_ENCODERS: dict = {}
