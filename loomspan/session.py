"""Session settings that every job shares: the shared scratch folder and Arrow batch sizes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 1000


class _Scopes(threading.local):
    """Paths that materialise() made inside each of this thread's open scratch scopes, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset (local tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back, which cuts its lineage.

    Lost executors only cost the tasks that were running: everything written stays readable.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df as the right side of a join by sorting, which no estimate turns into a broadcast.

    Spark estimates a table by its compressed files and exploded rows by the rows before, so what it takes for a few MB may be more than the driver holds.
    """
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that materialise() made and that nothing reads any more."""
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose tables are deleted at its end, but for those made by the function it gives, which works as materialise().

    Nothing lazy may leave the scope but what that function returns. A kept table belongs to the scope around, if there is one; `tables` of the function lists what else
    was written. Scopes belong to the thread that opens them.
    """
    mine: list[str] = []
    outer = _scopes.open[-1] if _scopes.open else None
    _scopes.open.append(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        path = mine.pop()
        if outer is not None:
            outer.append(path)
        return out

    keep.tables = mine
    try:
        yield keep
    finally:
        _scopes.open[:] = [s for s in _scopes.open if s is not mine]
        for path in mine:
            _delete(spark, path)


def _show_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is run from a folder and not installed."""
    home, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if home not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (home, known.get("PYTHONPATH", "")) if x)


def small_arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of one Arrow batch, so that a Python worker holds megabytes of text and not gigabytes."""
    _show_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the jobs that run inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
