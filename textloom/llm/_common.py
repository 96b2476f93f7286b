"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space that ends a word, as a class for SQL and for Python.
WORD_BREAK = r"[ \t\n\x0B\f\r]"
#: Unicode's White_Space property, which the tokenizers' \s means.
WHITE_SPACE = " \t\n\r\x0b\x0c\x85\xa0  -     　"

#: Runs of white space with the text after them. No pre-token of the public pattern holds white space behind
#: other characters, so each piece can be encoded without its neighbours.
PIECES = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


#: Longer keys are not remembered.
LONGEST_KEY = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, a folder of this run if unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = sc._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            named = set_before.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="textloom-")
            sc.setCheckpointDir(named)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, within that of this application."""
    return f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to a path and reads it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that its lineage ends there and lost executors cost nothing."""
    return stored(df, scratch(df.sparkSession, what))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that these operators have left in the shared folder for this application; for use when no result of theirs is still to be read."""
    discard(spark, _own_dir(spark))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterable[pa.RecordBatch], chars: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds few rows of long texts; a row is never cut."""
    for batch in batches:
        n, at = batch.num_rows, 0
        while at < n:
            step = n - at
            while step > 1 and batch.column(column).slice(at, step).nbytes > chars:
                step = max(1, step // 2)
            yield batch.slice(at, step)
            at += step


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches without the cycle collector (there are no cycles, only many small objects), which gives back what it freed, as
    the workers of earlier stages live on beside those of later ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            _give_back()

    return wrapped


class Memo(dict):
    """Remembers f(key) for at most `most` keys of at most LONGEST_KEY characters and then begins anew, so its memory is bounded."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.f(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value
