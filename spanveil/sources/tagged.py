"""Tagged corpora as a data source: JSON lines {"id": ..., "text": ..., "entities": [[start, end, label], ...]}.

    spark.dataSource.register(TaggedSource)
    df.write.format("tagged").mode("append").save(path)
    spark.read.format("tagged").load(path)

A reader's partition is a stretch of PIECE bytes of a file: it takes the lines that begin in it, so large files are read by many tasks. A writer's task writes a file of its
own in a folder that readers pass over; the commit moves the files of all tasks to their place, an abort deletes them. Tasks that run twice leave one file: only
those that the commit names are moved.

Defined cases: an empty folder has no rows; blank lines are none; a null text stays null; a broken line is an error that names its file. Paths are local, or whatever the
file systems of Arrow know.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spanveil.session import ship

SCHEMA = "id string, text string, entities array<struct<start:int,end:int,label:string>>"
PIECE = 32_000_000
_PENDING = "_pending"


def _open(path: str):
    """File system and path of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class TaggedReader(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs

        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if system.get_file_info(root).type != fs.FileType.File else [system.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Stretch(name, a, min(size, a + self.piece)) for name, size in files for a in range(0, size, self.piece)] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.file:
            return
        system, _ = _open(self.path)
        with io.BufferedReader(system.open_input_file(partition.file), 1 << 20) as f:
            # A line belongs to the stretch that holds its first byte: one that begins before is passed over.
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                at += len(line)
                if line.strip():
                    try:
                        row = json.loads(line)
                        yield str(row["id"]) if row.get("id") is not None else None, row["text"], [(int(a), int(b), str(k)) for a, b, k in row.get("entities") or []]
                    except (ValueError, KeyError, TypeError) as e:
                        raise ValueError(f"{partition.file}: no tagged line") from e


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int

    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class TaggedWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _pending(self) -> tuple:
        system, root = _open(self.path)
        return system, root, f"{root}/{_PENDING}-{self.run}"

    def write(self, rows: Iterator) -> Written:
        system, _, pending = self._pending()
        system.create_dir(pending, recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{pending}/{name}") as f:
            for r in rows:
                made = {"id": r["id"], "text": r["text"], "entities": [[e["start"], e["end"], e["label"]] for e in r["entities"] or []]}
                f.write((json.dumps(made, ensure_ascii=False) + "\n").encode("utf-8", "surrogatepass"))
                n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root, pending = self._pending()
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{pending}/{m.file}", f"{root}/part-{m.file}")
        self._clear(system, pending)

    def abort(self, messages: list) -> None:
        system, _, pending = self._pending()
        self._clear(system, pending)

    @staticmethod
    def _clear(system, pending: str) -> None:
        from pyarrow import fs

        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class TaggedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TaggedReader:
        return TaggedReader(self.options["path"], int(self.options.get("piece", PIECE)))

    def writer(self, schema: StructType, overwrite: bool) -> TaggedWriter:
        return TaggedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(TaggedSource)
