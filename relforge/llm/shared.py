"""What the corpus operators share: code shipping, batching of long texts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from relforge.sources.scratch import saved, shared_dir  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch on its way to a Python worker, so that its memory doesn't follow the rows' number.
BATCH_BYTES = 2_000_000


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, and bounds the batches that they get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="relforge-"), "relforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def text_slices(column: pa.Array, max_bytes: int = 1_000_000, max_rows: int = 4_096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of max_rows rows of about max_bytes; nulls are empty.

    A longer text is a run of its own, so that working memory follows the longest text and not the batch.
    """
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(ends, ends[at] + max_bytes, side="right")) - 1
        stop = min(max(stop, at + 1), at + max_rows, len(column))
        yield at, stop, raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
        at = stop


def copied(data: pa.Array) -> list[str]:
    """The column's texts; nulls are empty."""
    return data.fill_null("").to_pylist()
