"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

DuckDB does the work on one Arrow slice at a time inside mapInArrow: a slice is registered, one statement splits
texts into units, draws from a digest of the id, cuts, joins and rebuilds, and its Arrow result is handed on. No row
is touched in Python. Draws depend on seed and id alone, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What is cut between: runs of ASCII letters, and every other character alone.
UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED, RATE, SPM = "1", 90, 20
SCHEMA = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def _statement(seed: str, rate: int, spm: int, columns: list[str]) -> str:
    """From slice (id, t) to the columns of SCHEMA that are asked for."""
    mark = "'" + seed.replace("'", "''") + ":'"
    draws = ", ".join(f"('0x' || substr(drawn, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    return rf"""
WITH units AS (SELECT id, t, regexp_extract_all(t, '{UNIT}') AS u, sha256({mark} || coalesce(id::VARCHAR, '')) AS drawn FROM slice),
draws AS (SELECT id, t, u, len(u) AS n, {draws} FROM units),
places AS (SELECT id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT id, t, n, form, CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(u, 1, lo), '') END AS p,
  CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(u, lo + 1, hi), '') END AS m, CASE WHEN form = 'plain' THEN NULL ELSE array_to_string(list_slice(u, hi + 1, n), '') END AS s FROM places),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM parts),
back AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN split_part(split_part(output, '{SUFFIX}', 1), '{PREFIX}', 2) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{MIDDLE}', 1), '{SUFFIX}', 2)
  ELSE split_part(split_part(output, '{MIDDLE}', 1), '{PREFIX}', 2) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{PREFIX}', 1), '{SUFFIX}', 2) END AS restored FROM made),
named AS (SELECT id, n::BIGINT AS n, form, length(p)::BIGINT AS prefix_chars, length(m)::BIGINT AS middle_chars, output, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back)
SELECT {", ".join(columns)} FROM named"""


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = SEED, rate: int = RATE, spm: int = SPM, texts: bool = True, digests: bool = True) -> DataFrame:
    """One row for each row of docs: id_col, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    n counts units (UNIT). The first four groups of 8 digits of the SHA-256 of "<seed>:<id>" are h1 to h4. The
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. form is plain
    if the text is empty or holds a marker, or if h3 % 100 >= rate; else spm if h4 % 100 < spm, else psm. output is
    the text, <P>prefix<S>suffix<M>middle or <S>suffix<P>prefix<M>middle; the restored text is made from output and
    form alone. prefix_chars and middle_chars count code points and are null for plain rows. Null text counts as
    empty, a null id as an empty string in the draw; repeated rows come out alike, once each. An empty table gives
    no rows; other columns are ignored. Without texts there is no output column, without digests there are none.
    Memory is bounded by a slice of 2 MB or one longer text, of which every unit takes a list entry of 16 bytes.
    """
    fields = [c for c in SCHEMA.split(", ") if (texts or not c.startswith("output string")) and (digests or "sha256" not in c)]
    columns = [c.split()[0] for c in fields]
    statement = _statement(seed, rate, spm, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})  # a task's one core, and nothing on the machine's own disk
        try:
            for batch in batches:
                for part in slices(batch, "t"):
                    con.register("slice", pa.Table.from_batches([part]))
                    yield from con.sql(statement).to_arrow_table().to_batches()
                    con.unregister("slice")
        finally:
            con.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, ", ".join(fields)).withColumnRenamed("id", id_col)
