"""A session with the settings that the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "threadloom", **more: str) -> SparkSession:
    """Adaptive execution, UTC, and the state store of the streaming operators; more settings by name, dots as __."""
    conf = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(name).config(map=conf | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()
