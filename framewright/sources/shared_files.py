"""Files on the shared file system, written by tasks and moved into place when all of them are done.

Tasks write below ``_temporary/<job>``, each attempt in a folder of its own; the driver moves what the successful
attempts have written, one folder or file for each task, and removes the rest.  A failed job leaves no file.
Paths go to the file system that they name (``hdfs://``, ``s3://``, ``gs://``); ``file://`` and bare
paths are of a mount that the driver and all executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written, and under which name it is to stay (None: nothing)."""

    temporary: str
    final: str | None


class AttemptWriter(DataSourceArrowWriter):
    """Tasks write through ``fill``; commit and abort are the same for all kinds of files."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def temporary(self, task: str = "") -> str:
        return f"{located(self.path)[1]}/_temporary/{self.job}/{task}"

    def fill(self, system: fs.FileSystem, folder: str, batches: Iterator[pa.RecordBatch]) -> tuple[str, str | None]:
        """Writes a task's rows below the folder; gives what is to be moved, and its final name."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task, (system, _) = TaskContext.get(), located(self.path)
        folder = self.temporary(f"{task.partitionId()}-{task.taskAttemptId()}")
        system.create_dir(folder)
        return Written(*self.fill(system, folder, iterator))

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        for m in messages:
            if m is not None and m.final:
                system.move(m.temporary, f"{path}/{m.final}")
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(located(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        if system.get_file_info(self.temporary()).type != fs.FileType.NotFound:
            system.delete_dir(self.temporary())


class FileWriter(AttemptWriter):
    """A file for each row (name, content), in one folder for each task."""

    def fill(self, system, folder, batches):
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"not a file name: {name!r}")
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_buffer())
                n += 1
        return folder, f"part-{TaskContext.get().partitionId():05d}-{self.job}" if n else None


class FilesSink(DataSource):
    """Batch sink ``named_files``: option ``path``, rows (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def write_files(rows: DataFrame, path: str) -> None:
    """A file for each row (name, content) below the path, which is a new folder or one with other files; all of them or none."""
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select("name", "content").write.format("named_files").option("path", path).mode("append").save()
