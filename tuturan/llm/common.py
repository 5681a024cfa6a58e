"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tuturan.session import scratch_path

# A document of the held-out part: crc32 of its id, as text, leaves this remainder.
FOLDS, HELD_OUT = 4, 2


def ship(spark: SparkSession) -> None:
    """Give executors the package, once a session, whether or not it is installed there."""
    context = spark.sparkContext
    if getattr(context, "_tuturan_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tuturan-"), "tuturan.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)  # the driver serves it; nothing is read by path on an executor
    context._tuturan_shipped = True


def held_out(doc_id="doc_id"):
    """True for the rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % FOLDS == HELD_OUT


def write_once(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_arrow(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of ``df`` plus columns computed from whole Arrow batches.

    ``make`` is called once in each task and gives the function of a batch. A computed column
    replaces a kept one of the same name.
    """
    names = [n for n, _ in fields]
    lower = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in lower]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(n, kind) for n, kind in fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(own + work(batch), names=kept + names)

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; a null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b"" if x is None else x for x in column.to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
