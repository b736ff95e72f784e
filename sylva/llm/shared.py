"""Folders that driver and executors share, and raw files in them.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; one of our own is made
only where that setting is absent (single-machine tests).  Raw files go through ``pyarrow.fs``, so
any scheme that it knows works; each is written under a per-attempt name and then renamed, so
that a task run twice (lost executor, speculation) leaves one whole file.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "sylva-shared")
        os.makedirs(found, exist_ok=True)
    if "://" not in found and not found.startswith("file:"):
        found = f"file://{os.path.abspath(found)}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's own folder below the shared one: that folder may go when the application has ended."""
    return f"{shared_dir(spark)}/sylva-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Paths of tables that go when the innermost :func:`passing` block ends.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables that are written down within the block go at its end, but for those that are kept."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            forget(spark, path)


def persist(df: DataFrame, label: str, *, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    Within :func:`passing` the table goes when the block ends; with ``keep`` when the next outer one does.
    """
    return persist_at(df, label, keep=keep)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`fresh_path` that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def persist_at(df: DataFrame, label: str, *, keep: bool = False) -> tuple[DataFrame, str]:
    """As :func:`persist`, and the path, for :func:`forget`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    owners = _PASSING[:-1] if keep else _PASSING
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def open_fs(uri: str):
    """(file system, path within it) of a URI."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def whole_file(uri: str):
    """A stream whose bytes become the file ``uri`` at once when the block ends well: a temporary name beside it, then a rename."""
    system, path = open_fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    passing = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(passing) as out:
            yield out
        try:
            system.move(passing, path)
        except OSError:  # another attempt of the same task was first
            if system.get_file_info(path).type.name != "File":
                raise
            system.delete_file(passing)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(passing)
        raise
