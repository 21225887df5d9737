"""What the corpus operators share: durable intermediate tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that this process has written.
written: list[str] = []
#: Bytes of text that an operator turns into arrays at once; a longer text is a slice of its own.
SLICE = 2 << 20
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); a temporary one only in local mode, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='threadloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors.

    Unlike a checkpoint, which keeps its plan's estimate of size, the table has the size of its files. In loops
    estimates of joins multiply round by round until the numbers fill the driver's memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, tables: list[DataFrame | str]) -> None:
    """Deletes tables of kept_table, given as frames or paths, that no frame in use reads any more; other files are left alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    own = path(f"{shared_dir(spark)}/tables")
    own = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString() + "/"
    folders = {f.rsplit("/", 1)[0] for t in tables if isinstance(t, DataFrame) for f in t.inputFiles()}
    for folder in folders | {t for t in tables if isinstance(t, str)}:
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.makeQualified(path(folder)).toString().startswith(own):
            fs.delete(path(folder), True)


def as_struct(docs: DataFrame) -> F.Column:
    """All columns of a row as one struct, so that none can clash with a name that an operator uses."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in `column` have `most` bytes at most, or one row: bounds the arrays made of them."""
    for lo, hi in text_bounds(batch.column(column), most):
        yield batch.slice(lo, hi - lo)


def text_bounds(column: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo, done = [], 0, 0
    while lo < len(ends):
        hi = max(int(np.searchsorted(ends, done + most, "right")), lo + 1)
        out.append((lo, hi))
        lo, done = hi, int(ends[hi - 1])
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text starts (one more entry than texts). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return flat, (offsets - offsets[0]) if len(column) else np.zeros(1, np.int64)


def unsigned_crc(column: str) -> F.Column:
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8"))


def rows_kept(docs: DataFrame, chosen: DataFrame, digest: F.Column, id_col: str) -> DataFrame:
    """The rows of docs that `chosen` (id_col, digest) has, with all their columns.

    Ids that are chosen as often as docs has them keep their rows without a look at any text. Of the others the
    rows with a chosen digest stay, one for each id and digest. Documents are shuffled once, by id; the hint keeps
    it so at every size, as the ids that stay are as many as the documents.
    """
    want = chosen.groupBy(F.col(id_col).alias("want")).agg(F.count("*").alias("n"))
    have = docs.select(F.col(id_col).cast("bigint").alias("have")).groupBy("have").agg(F.count("*").alias("m"))
    both = kept_table(want.join(have, F.col("want").eqNullSafe(F.col("have"))).select("want", (F.col("n") < F.col("m")).alias("some")), "chosen")
    rows = docs.select(as_struct(docs).alias("whole"), F.col(id_col).cast("bigint").alias("have"))
    met = F.col("have").eqNullSafe(F.col("want"))
    plain = rows.join(both.filter("not some").hint("merge"), met, "left_semi").select("whole.*")
    if both.filter("some").isEmpty():
        return plain
    pairs = chosen.select(F.col(id_col).alias("want"), F.col("digest").alias("wanted"))
    some = docs.select(as_struct(docs).alias("whole"), F.col(id_col).cast("bigint").alias("have"), digest.alias("digest")).join(both.filter("some"), met, "left_semi")
    some = some.join(pairs, met & (F.col("digest") == F.col("wanted")), "left_semi").dropDuplicates(["have", "digest"])
    return plain.unionByName(some.select("whole.*"))
