"""Objects of a store as a Spark data source: ``spark.read.format("objects").option("path", uri).load()``.

Folders below the path are partitions and are listed by tasks; only the first level is listed by the driver.  Any store that Arrow's file systems know can be read.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, created timestamp, updated timestamp, content_type string, md5_hash string, error string"
#: Types by extension, and any other file's (fixed values).
TYPES = {"mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "wav": "audio/wav", "png": "image/png", "jpg": "image/jpeg", "txt": "text/plain", "json": "application/json"}
OTHER = "application/octet-stream"
#: Bytes that are read at once for a digest, and files of the first level that are one partition.
STEP, FILES = 1 << 20, 256


class Part(InputPartition):
    """A folder with all that lies below it, or some files."""

    def __init__(self, folder: str | None, files: list[str]):
        super().__init__(folder)
        self.folder, self.files = folder, files


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("option path names the folder or object to list")
        self.uri, self.digest = options["path"], options.get("md5", "false").lower() == "true"

    def store(self):  # noqa: ANN201
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri if "://" in self.uri else "file://" + os.path.abspath(self.uri))
        return store, path, self.uri.split("://", 1)[0] if "://" in self.uri else "file"

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path, _ = self.store()
        if store.get_file_info(path).type == fs.FileType.File:
            return [Part(None, [path])]
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        folders = [Part(f.path, []) for f in found if f.type == fs.FileType.Directory]
        files = sorted(f.path for f in found if f.type == fs.FileType.File)
        return folders + [Part(None, files[k : k + FILES]) for k in range(0, len(files), FILES)] or [Part(None, [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _, scheme = self.store()
        found = store.get_file_info(fs.FileSelector(partition.folder, recursive=True)) if partition.folder else store.get_file_info(partition.files)
        for f in found:
            if f.type == fs.FileType.File:
                yield self.row(store, scheme, f)

    def row(self, store, scheme: str, f) -> tuple:  # noqa: ANN001
        """One object that can't be read has an error, and stops nothing."""
        md5, created, error = None, None, None
        try:
            if scheme == "file" and hasattr(os.stat(f.path), "st_birthtime"):
                created = dt.datetime.fromtimestamp(os.stat(f.path).st_birthtime, dt.UTC)
            if self.digest:
                h = hashlib.md5(usedforsecurity=False)
                with store.open_input_stream(f.path) as s:
                    while block := s.read(STEP):
                        h.update(block)
                md5 = h.hexdigest()
        except OSError as e:
            error = f"{type(e).__name__}: {e.strerror or e}"
        kind = TYPES.get(f.extension.lower(), OTHER)
        return f"{scheme}://{f.path}", f.size, created, f.mtime, kind, md5, error


class ObjectSource(DataSource):
    """created is null where the store doesn't tell; md5_hash needs option ``md5=true``, which reads the objects."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ObjectReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)
