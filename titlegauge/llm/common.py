"""What the operators share: tables, Arrow batches of bounded text size, hash splits."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegauge.session import cut_lineage

#: Text bytes that one Python step holds at once; a longer document makes a step of its own.
STEP_BYTES = 4 << 20
#: Bytes of a batch on its way between Spark and a Python worker (10,000 long rows would be many times that).
ARROW_BYTES = 8 << 20


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, besides their own path.

    A cluster that does not share that folder gets the package by ``--py-files`` as usual. Batches of
    rows that they are sent are bounded by bytes, whatever the length of a row.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which survives a lost executor."""
    let_workers_import(df.sparkSession)
    return cut_lineage(df)


def id_text(doc_id: Column) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def crc_remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(id_text(doc_id)) % n


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns under fixed names, so extra columns of the input never clash."""
    let_workers_import(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")
    )


def text_steps(
    batches: Iterable[pa.RecordBatch], limit: int = STEP_BYTES, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have at most ``limit`` bytes or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def map_steps(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``step`` over each bounded batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            yield step(batch)

    return df.mapInArrow(run, schema)


def record_batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def texts(column: pa.Array) -> list[str]:
    """Python strings; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def rows_of_bytes(matrix: np.ndarray) -> pa.Array:
    """Each row of a C-contiguous matrix as one binary value."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(matrix.shape[0] + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), matrix.shape[0], [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))]
    ).cast(pa.binary())
