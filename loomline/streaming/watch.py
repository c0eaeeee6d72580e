"""Changes of a folder as a stream: a source whose offset is the number of a listing."""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "path string, change string, modified_ns long, size long, version long"


class _Listings:
    """Numbered listings and the changes that led to each, as JSON lines in one folder; a file is there whole or not at all."""

    def __init__(self, folder: str):
        self.files, self.folder = pafs.FileSystem.from_uri(folder)

    def write(self, name: str, rows: list) -> None:
        self.files.create_dir(self.folder)
        part = f"{self.folder}/_{name}.part"
        with self.files.open_output_stream(part) as out:
            for row in rows:
                out.write(json.dumps(row).encode() + b"\n")
        self.files.move(part, f"{self.folder}/{name}")

    def read(self, name: str) -> Iterator[list]:
        with self.files.open_input_stream(f"{self.folder}/{name}") as source:
            rest = b""
            while chunk := source.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from map(json.loads, lines)

    def last(self) -> int:
        found = self.files.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        numbers = [int(f.base_name.split("-")[1]) for f in found if f.base_name.startswith("listing-")]
        return max(numbers, default=0)


class _Version(InputPartition):
    def __init__(self, version: int):
        self.version = version


class FolderChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self._path, self._folder = options["path"], options["listings"]
        self._pattern = options.get("pattern", "*")

    def _now(self) -> dict[str, tuple[int, int]]:
        files, root = pafs.FileSystem.from_uri(self._path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        return {posixpath.relpath(f.path, root): (f.mtime_ns, f.size) for f in found
                if f.is_file and fnmatch.fnmatch(f.base_name, self._pattern)}

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """Takes a new number only if the folder differs from the last listing."""
        listings = _Listings(self._folder)
        last = listings.last()
        before = {path: (at, size) for path, at, size in listings.read(f"listing-{last}")} if last else {}
        now = self._now()
        changes = [[p, "created" if p not in before else "modified", *v] for p, v in sorted(now.items()) if before.get(p) != v]
        changes += [[p, "deleted", *before[p]] for p in sorted(before.keys() - now.keys())]
        if not changes:
            return {"version": last}
        # the listing is written last: a number without one is given again
        listings.write(f"changes-{last + 1}", changes)
        listings.write(f"listing-{last + 1}", [[p, *v] for p, v in sorted(now.items())])
        return {"version": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Version(v) for v in range(start["version"] + 1, end["version"] + 1)]

    def read(self, partition: _Version) -> Iterator[tuple]:
        for row in _Listings(self._folder).read(f"changes-{partition.version}"):
            yield (*row, partition.version)

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> FolderChangeReader:
        return FolderChangeReader(self.options)


def file_change_stream(spark: SparkSession, path: str, listings: str, pattern: str = "*") -> DataFrame:
    """Stream of (path, change, modified_ns, size, version): files created, modified (other time or size) and deleted below ``path``.

    ``path`` and ``listings`` (kept by this source, one watch a folder) are URIs that the driver and executors both
    reach. Every file is created in the first listing; an unchanged folder gives no rows, a missing one is empty. The
    driver holds one listing, as Spark's own file source does. What comes and goes between two listings is not seen.
    """
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("listings", listings).option("pattern", pattern).load(path)
