"""A log of events as a streaming source of its own: numbered parquet files, read in batches of a fixed number of rows.

Offsets count rows from the start of the log, so a batch is the same rows whenever and wherever it is read: a query that comes back from
its checkpoint neither loses nor doubles an event, and a batch's size is bounded in rows, not in files. Tasks read slices of files by
their row groups; the driver reads footers only. Appending adds files after all others, and a running query goes on to them.

Cases: an empty log gives no batch; a null in the order's columns comes first; equal events are events of their own; files without rows are
passed over; files must not change once they are written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch and of a task of it, where none are asked for.
ROWS_PER_BATCH, ROWS_PER_TASK = 1_000_000, 100_000


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _files(folder: str) -> list[str]:
    """Paths of the log's files in order: by append, then by part."""
    store, path = _opened(folder)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    names = [f.path[len(path) :].strip("/") for f in found if f.type == fs.FileType.File]
    return sorted(n for n in names if n.endswith(".parquet") and not any(part.startswith((".", "_")) for part in n.split("/")))


def appended(events: DataFrame, folder: str, order: Sequence[str], partitions: int | None = None) -> None:
    """Write ``events`` after all that the log in ``folder`` has, in ``order``: sorted by ranges, never in one task."""
    last = max((int(name.split("/", 1)[0].partition("=")[2]) for name in _files(folder)), default=-1)
    ranged = events.repartitionByRange(partitions, *order) if partitions else events.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.parquet(f"{folder}/append={last + 1:08d}")


class Slice(InputPartition):
    """Rows [start, end) of one file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class LogReader(DataSourceStreamReader):
    """Plans batches on the driver, by footers, and reads slices in tasks."""

    def __init__(self, folder: str, rows_per_batch: int, rows_per_task: int, schema: StructType) -> None:
        self.folder, self.rows_per_batch, self.rows_per_task, self.columns = folder, rows_per_batch, rows_per_task, to_arrow_schema(schema)
        self.rows: dict[str, int] = {}
        self.at: int | None = None

    def _known(self) -> dict[str, int]:
        """Rows by file, in order; each footer is read once."""
        store, path = _opened(self.folder)
        for name in _files(self.folder):
            if name not in self.rows:
                with store.open_input_file(f"{path}/{name}") as file:
                    self.rows[name] = pq.ParquetFile(file).metadata.num_rows
        return dict(sorted(self.rows.items()))

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        self.at = min((self.at or 0) + self.rows_per_batch, max(self.at or 0, sum(self._known().values())))
        return {"rows": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.at is None:  # a query that comes back is planned from where it was
            self.at = end["rows"]
        out: list[InputPartition] = []
        before = 0
        for name, n in self._known().items():
            a, b = max(0, start["rows"] - before), min(n, end["rows"] - before)
            out += [Slice(name, k, min(b, k + self.rows_per_task)) for k in range(a, b, self.rows_per_task)]
            before += n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, path = _opened(self.folder)
        with store.open_input_file(f"{path}/{partition.path}") as source:
            file, at = pq.ParquetFile(source, coerce_int96_timestamp_unit="us"), 0
            for group in range(file.num_row_groups):
                n = file.metadata.row_group(group).num_rows
                a, b = max(0, partition.start - at), min(n, partition.end - at)
                if a < b:
                    yield from file.read_row_group(group, columns=self.columns.names).slice(a, b - a).select(self.columns.names).cast(self.columns).to_batches()
                at += n


class EventLog(DataSource):
    """Options: path, ddl (the log's columns), rowsperbatch, rowspertask."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> StructType | str:
        return self.options["ddl"]

    def streamReader(self, schema: StructType) -> LogReader:
        rows = int(self.options.get("rowsperbatch", ROWS_PER_BATCH))
        return LogReader(self.options["path"], rows, int(self.options.get("rowspertask", ROWS_PER_TASK)), schema)


def streamed(spark: SparkSession, folder: str, schema: StructType, rows_per_batch: int = ROWS_PER_BATCH, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The log in ``folder`` as a stream."""
    spark.dataSource.register(EventLog)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return spark.readStream.format("eventlog").option("path", folder).option("ddl", ddl).option("rowsPerBatch", rows_per_batch).option("rowsPerTask", rows_per_task).load()
