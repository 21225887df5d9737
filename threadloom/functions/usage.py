"""Token usage that responses report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.tokens import MOST, saturating_add

INPUTS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
WHOLE = r"^[0-9]{1,18}$"


def lenient(value: Column) -> Column:
    """The whole part of a number; 0 for what is negative, missing or none; at most 2^63 - 1."""
    d = value.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (d <= 0), F.lit(0).cast("bigint")).when(d >= float(MOST), F.lit(MOST)).otherwise(F.floor(d).cast("bigint"))


def total_input(usage: dict[str, Column]) -> Column:
    total = F.lit(0).cast("bigint")
    for k in INPUTS:
        total = saturating_add(total, lenient(usage[k]))
    return total


def strict_total(message_type: Column, usage: dict[str, Column]) -> Column:
    """The sum of the fields of a message's usage, or null if any is malformed or none is positive."""
    ok = message_type == "message"
    total = F.lit(0).cast("bigint")
    for k in INPUTS:
        ok &= usage[k].isNull() | usage[k].rlike(WHOLE)
        total = total + F.coalesce(usage[k].try_cast("bigint"), F.lit(0))
    return F.when(ok & (total > 0), total)


def scaled(usage: dict[str, Column], output: Column, has_total: Column, factor: float) -> dict[str, Column]:
    """Input fields times the factor, rounded down, and their total with the output; with a factor of 1 or more as they were."""
    def one(k: str) -> Column:
        d = usage[k].try_cast("double")
        return F.when(usage[k].isNull(), F.lit(None)).when(F.coalesce(d, F.lit(0.0)) > 0, F.floor(d * factor) if factor < 1 else d).otherwise(d).cast("double")

    parts = {f"scaled_{k}": one(k) for k in INPUTS}
    total = F.lit(0.0)
    for c in parts.values():
        total = total + F.when(F.coalesce(c, F.lit(0.0)) > 0, c).otherwise(0.0)
    return parts | {"scaled_total_tokens": F.when(has_total, total + F.coalesce(output.cast("double"), F.lit(0.0)))}


def update_kind(actual: Column, tracked: Column, current: Column, bound: Column) -> Column:
    """What a response does to its session's baseline: none, stale or exact."""
    return F.when((F.coalesce(actual, F.lit(0)) <= 0) | ~tracked | ~bound, "none").when(~current, "stale").otherwise("exact")
