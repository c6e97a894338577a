"""Shared folders, staged tables and files that executors publish, for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset, a new local one is set if the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lakeshore-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name below the shared folder that no other call gets."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete all folders made so far: for the end of a job, when no result of an operator is read any more."""
    while _made:
        dropped(spark, _made.pop())


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows that are worth a task of their own.
TASK_ROWS = 20_000


def compact(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of at most about ``rows`` rows, in no more partitions than those fill: loops over shrinking tables don't pay
    for empty tasks and files. Large tables keep the partitions they have."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def dropped(spark: SparkSession, uri: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstaged(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`staged`, which nothing may read after this."""
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        dropped(df.sparkSession, uri)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write: Callable[[BinaryIO], object]) -> object:
    """Call ``write(file)`` on a hidden name, then move it to ``uri``: a repeated task replaces the file whole."""
    store, path = _store(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        result = write(out)
    store.move(hidden, path)
    return result


def opened(uri: str):
    """A seekable input file for ``uri``."""
    store, path = _store(uri)
    return store.open_input_file(path)


_memory: dict[str, object] = {}


def memory(owner: str, make: Callable[[], object]) -> object:
    """What ``owner`` remembers in this Python worker, made when it is first asked for. A worker outlives its tasks and is used by all
    operators in turn, so it remembers for one owner at a time: asking for another one's memory drops it."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = make()
    return _memory[owner]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named by their places, so that no name clashes; ``toDF`` names them again."""
    return df.toDF(*[f"own_{k}" for k in range(len(df.columns))])


def set_aside(df: DataFrame, *added: str) -> DataFrame:
    """``df`` with its own columns of the ``added`` names under those names and ``_own``, so that nothing of the caller's is lost."""
    for name in added:
        if name in df.columns:
            new = f"{name}_own"
            while new in df.columns:
                new += "_own"
            df = df.withColumnRenamed(name, new)
    return df


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with the fields of ``ddl`` after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
