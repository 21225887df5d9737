"""Routing of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracked(requests: DataFrame) -> DataFrame:
    """Requests whose session keeps state: those of main and unknown agents."""
    return requests.filter(F.col("request_role").isin("main", "unknown"))


def bypassing(requests: DataFrame) -> DataFrame:
    """Requests that go through as they are, before any state is touched."""
    return requests.filter(~F.col("request_role").isin("main", "unknown"))


def passed_through(responses: DataFrame) -> DataFrame:
    """Responses that aren't of success; their usage isn't read."""
    return responses.filter(~F.col("status").between(200, 299))
