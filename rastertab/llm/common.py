"""Passes over document texts that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}
PIECE_ROWS = 512  # rows handed to a step at once; bounds a task's memory beside its longest texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_texts(
    docs: DataFrame, start: Callable[[], Callable], added: str, keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the columns ``added`` (DDL) that a step makes from the texts.

    ``start`` runs once per task and returns the step: a function from a list of texts (None for NULL) to one
    sequence per added column. Rows stay in their partition; other columns of ``docs`` are never read.
    """
    new = T.StructType.fromDDL(added)
    kept = [docs.schema[c] for c in keep]
    types = [ARROW[f.dataType.simpleString()] for f in new]
    names = [*keep, *new.names]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                values = step(piece.column(n).to_pylist())
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *made], names=names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, T.StructType([*kept, *new]))


def lists_of(values: np.ndarray, counts: Sequence[int], of: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, of))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows with the smallest hash of ``key``: a fixed choice, small enough to send anywhere."""
    return rows.orderBy(F.xxhash64(key), key).limit(limit)
