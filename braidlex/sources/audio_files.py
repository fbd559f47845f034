"""Speech as files with a commit: WAV files and a manifest through Spark's data source interface.

``df.write.format("wav").mode("append").save(folder)`` takes rows (path, wav,
seconds, error). A task writes its files, and a list of them, under a folder of
its own below ``_temporary`` and tells the driver that folder and its counts;
when all tasks have ended, the driver renames each folder to a part of the
result and writes the manifest last. Its existence is the commit: what no
manifest names does not count. Where a task fails, or the job, nothing but the
temporary folder was touched, and that is removed. The driver holds one name a
task, never one a file. Rows with an error have no file; the manifest counts
them.

``spark.read.format("wav").load(folder)`` reads the files of all manifests, a
partition for each part.

Files are reached through pyarrow's file systems, so the folder is any place
that all executors share: a mounted path, or a URI that pyarrow knows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, wav binary, seconds double, error string"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        system, path = pafs.FileSystem.from_uri(folder)
    else:
        system, path = pafs.LocalFileSystem(), folder
    return system, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """One task's folder and counts."""

    folder: str
    success: int
    failed: int
    seconds: float


class WavWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.job, self.overwrite = folder, uuid.uuid4().hex, overwrite
        system, path = opened(folder)
        system.create_dir(self._temporary(path), recursive=True)

    def _temporary(self, path: str) -> str:
        return f"{path}/_temporary/{self.job}"

    def write(self, rows: Iterator) -> Written:
        """In a task: its files under a folder of its own, so a task that is run again writes others."""
        system, path = opened(self.folder)
        own = f"{self._temporary(path)}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=False)  # fails where the job is over: a task that outlives it leaves nothing
        places, failed, seconds = {}, 0, 0.0
        for row in rows:
            if row["error"] is not None or row["wav"] is None:
                failed += 1
                continue
            place = row["path"]
            if not place or place.startswith(("/", "_")) or ".." in place.split("/"):
                raise ValueError(f"{place!r} is no place in the folder")
            if place in places:
                raise ValueError(f"two rows for {place!r}")
            levels = place.split("/")[:-1]
            for n in range(len(levels)):
                system.create_dir("/".join([own, *levels[: n + 1]]), recursive=False)
            with system.open_output_stream(f"{own}/{place}") as out:
                out.write(bytes(row["wav"]))
            places[place] = len(row["wav"])
            seconds += row["seconds"] or 0.0
        if places:
            with system.open_output_stream(f"{own}/{LISTED}") as out:
                out.write(json.dumps(places, ensure_ascii=False).encode())
        return Written(own, len(places), failed, seconds)

    def commit(self, messages: list[Written]) -> None:
        """On the driver: each task's folder becomes a part, then the manifest says which parts there are."""
        system, path = opened(self.folder)
        before = manifests(self.folder)
        system.create_dir(path, recursive=True)
        done, parts = [m for m in messages if m is not None], []
        for m in done:
            if m.success:
                parts.append(f"part-{len(parts):05d}-{self.job}")
                system.move(m.folder, f"{path}/{parts[-1]}")
        success, failed = sum(m.success for m in done), sum(m.failed for m in done)
        record = {"total": success + failed, "success": success, "failed": failed, "seconds": round(sum(m.seconds for m in done), 3), "parts": parts}
        with system.open_output_stream(f"{path}/manifest-{self.job}.json") as out:
            out.write(json.dumps(record).encode())
        if self.overwrite:  # the new result stands; now the old one goes, its manifests first
            for name in before:
                old = json.loads(_text(system, name))["parts"]
                system.delete_file(name)
                for part in old:
                    system.delete_dir(f"{path}/{part}")
        self._clean(system, path)

    def abort(self, messages: list[Written]) -> None:
        self._clean(*opened(self.folder))

    def _clean(self, system: pafs.FileSystem, path: str) -> None:
        for held in (self._temporary(path), f"{path}/_temporary"):
            there = system.get_file_info(held).type != pafs.FileType.NotFound
            if there and (held != f"{path}/_temporary" or not system.get_file_info(pafs.FileSelector(held))):
                _removed(system, held)  # the common folder only where no other job is at work


def _removed(system: pafs.FileSystem, folder: str, attempts: int = 5) -> None:
    """Remove a folder into which a task may still be writing its last file."""
    for attempt in range(attempts):
        try:
            system.delete_dir(folder)
            return
        except FileNotFoundError:
            return
        except OSError:
            if attempt == attempts - 1:
                raise
            time.sleep(0.2 * 2**attempt)


#: A part's list of files and their sizes.
LISTED = "_files.json"


def _text(system: pafs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as f:
        return f.read().decode()


def manifests(folder: str) -> list[str]:
    system, path = opened(folder)
    found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


class WavReader(DataSourceReader):
    """The committed parts, one a partition."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.folder)
        parts = [part for name in manifests(self.folder) for part in json.loads(_text(system, name))["parts"]]
        return [InputPartition(part) for part in parts] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, path = opened(self.folder)
        part = f"{path}/{partition.value}"
        for place in json.loads(_text(system, f"{part}/{LISTED}")):
            with system.open_input_stream(f"{part}/{place}") as f:
                wav = f.read()
            rate, data = int.from_bytes(wav[24:28], "little"), len(wav) - 44
            yield place, wav, data / 2 / rate if rate else None, None


class WavFiles(DataSource):
    """Mono 16-bit WAV files in a folder, with manifests."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"path", "wav", "seconds", "error"} - set(schema.names)
        if missing:
            raise ValueError(f"the rows lack {', '.join(sorted(missing))}")
        return WavWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavFiles)
