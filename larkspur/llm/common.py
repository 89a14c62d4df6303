"""Helpers shared by the corpus operators: tables, shared storage and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset in local mode (tests) is a temporary folder made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths given out inside ``scratch``, innermost last.
_owned: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/larkspur/{label}-{uuid.uuid4().hex}"
    for paths in _owned[-1:]:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that are stored inside and deletes them on leaving: the result must have been written by then."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            delete(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and the loss of an
    executor costs nothing that has been written."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def released(made: DataFrame) -> None:
    """Deletes a ``stored`` table that nothing reads any more."""
    delete(made.sparkSession, made.stored_at)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``most_bytes``, one row at least: a worker's memory follows the longest row."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def in_batches(
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], most_bytes: int = 2 << 20
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that hands over ``slices``. ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(make(), slices(batches, most_bytes))
        pa.default_memory_pool().release_unused()  # the worker lives on, for other tasks

    return run


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
