"""Exports that appear whole or not at all: a writer of files by name, and of lines, with commit and abort.

Tasks write below a hidden folder of their job, each attempt in a folder of its own. When all are
done, the driver takes out what attempts that did not count have left, and shows the job's folder by
one rename; after a failed task it is deleted. So readers see all of a job's files or none, and tasks
may be lost or run twice. The file system must be one whose folders can be renamed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "whole_exports"


@dataclass
class Written(WriterCommitMessage):
    folder: str


def _names(system: fs.FileSystem, path: str) -> list[str]:
    return [x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True))]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, layout: str, batch: str | None, overwrite: bool):
        self.uri, self.layout, self.overwrite = path, layout, overwrite
        self.job = uuid.uuid4().hex
        self.batch = f"batch-{batch or self.job}"

    def _at(self) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        return system, root, f"{root}/_job-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, staged = self._at()
        folder = uuid.uuid4().hex
        at = f"{staged}/{folder}"
        system.create_dir(at)
        if self.layout == "lines":
            with system.open_output_stream(f"{at}/rows.jsonl") as out:
                for r in iterator:
                    out.write(r["value"].encode() + b"\n")
            return Written(folder)
        last, times = None, 0  # rows of a name stand together
        for r in iterator:
            name, value = r["file_name"], r["value"]
            if not name or value is None or "/" in name or name[0] in "._":
                raise ValueError(f"not a file that can be exported: {name!r}")
            last, times = name, times + 1 if name == last else 1
            stem, dot, kind = name.rpartition(".")
            if times > 1:
                name = f"{stem}-{times}.{kind}" if dot else f"{name}-{times}"
            with system.open_output_stream(f"{at}/{name}") as out:
                out.write(value.encode())
        return Written(folder)

    def commit(self, messages: list) -> None:
        system, root, staged = self._at()
        kept = {m.folder for m in messages if m is not None}
        for lost in set(_names(system, staged)) - kept:
            system.delete_dir(f"{staged}/{lost}")
        older = [n for n in _names(system, root) if n.startswith("batch-")]
        if self.batch in older and not self.overwrite:  # written before: a batch that is tried again is there once
            system.delete_dir(staged)
            return
        if self.batch in older:
            system.delete_dir(f"{root}/{self.batch}")
        system.create_dir(staged)
        system.move(staged, f"{root}/{self.batch}")
        for n in older if self.overwrite else []:
            if n != self.batch:
                system.delete_dir(f"{root}/{n}")

    def abort(self, messages: list) -> None:
        system, _, staged = self._at()
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class _Exports(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("layout", "files"), self.options.get("batch"), overwrite)


def _address(spark: SparkSession, path: str) -> str:
    """The whole address of a path, on the file system that Spark would take."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    told = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return told.replace("file:/", "file:///", 1) if told.startswith("file:/") and not told.startswith("file://") else told


def _save(rows: DataFrame, path: str, layout: str, batch: str | None, mode: str) -> None:
    path = _address(rows.sparkSession, path)
    rows.sparkSession.dataSource.register(_Exports)
    w = rows.write.format(FORMAT).option("layout", layout).mode(mode)
    (w if batch is None else w.option("batch", batch)).save(path)


def export_files(files: DataFrame, path: str, batch: str | None = None, mode: str = "append") -> None:
    """Write files (file_name, value) of a job below path, a file a row; of equal names the later ones, by value, are numbered from 2.

    A name is not empty, no path and no hidden file, and a value is not null; else the job fails and
    writes nothing. A named batch is written once: to append it again changes nothing. Overwriting
    takes away earlier batches once the new one is there.
    """
    rows = files.select("file_name", "value").repartition("file_name").sortWithinPartitions("file_name", "value")
    _save(rows, path, "files", batch, mode)


def append_lines(rows: DataFrame, path: str, batch: str | None = None, mode: str = "append") -> None:
    """Write rows of any columns as JSON lines, a file a task; null columns are left out of a line. Batches as in export_files."""
    _save(rows.select(F.to_json(F.struct("*")).alias("value")), path, "lines", batch, mode)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, value) of what export_files has written."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").text(path, wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # a name comes as in an address
    return t.select(name.alias("file_name"), "value")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
