"""Tables that operators write on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='threadloom-store-')}/store-{uuid.uuid4().hex}"


#: Folders of the tables that kept() wrote; they may go once a query's result has been read.
KEPT: list[str] = []


def kept(frame: DataFrame) -> DataFrame:
    """The frame's rows from a table in the shared folder: computed once, of known size, there after executors are lost."""
    KEPT.append(scratch(frame.sparkSession))
    frame.write.parquet(KEPT[-1])
    return frame.sparkSession.read.schema(frame.schema).parquet(KEPT[-1])
