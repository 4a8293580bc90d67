"""Changeable tables as a data source: spark.read.format("changeable").load(path), df.write.format("changeable").save(path).

Reading takes the latest version, or the one of the option `version`. Writing appends, or with mode overwrite replaces all
rows, as one new version; it is for tables that only have types and NOT NULL to hold. Tables with keys, checks,
references or triggers need ChangeableTable's own methods, which can look at the rows that are there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.sources.avro import file_system
from millrace.sources.table import Conflict, Violation, manifest_of, manifest_text


def latest(path: str, version: int | None = None) -> dict:
    """The manifest, with all files, of the latest whole version or of another one."""
    system, root = file_system(path)

    def text_of(v: int) -> str:
        with system.open_input_stream(f"{root}/versions/{v:09d}.json") as f:
            return f.read().decode()

    if version is None:
        found = system.get_file_info(fs.FileSelector(f"{root}/versions"))
        known = sorted((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json") and not f.base_name.startswith(".")), reverse=True)
        version = next(v for v in known if text_of(v).endswith("\n"))
    return manifest_of(text_of, version)


class ChangeableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changeable"

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def _manifest(self) -> dict:
        return latest(self._path(), int(self.options["version"]) if "version" in self.options else None)

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._manifest()["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChangeableReader(self._path(), schema, self._manifest()["files"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        m = self._manifest()
        if m["unique"] or m["checks"] or m["references"] or m["triggers"] or (overwrite and m["children"]):
            raise Violation(f"{self._path()} has keys, checks, references or triggers: use ChangeableTable")
        return ChangeableWriter(self._path(), schema, m, overwrite)


class ChangeableReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, files: list[str]):
        self.path, self.schema, self.files = path, schema, files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        system, root = file_system(self.path)
        kinds = to_arrow_schema(self.schema)
        with system.open_input_file(f"{root}/data/{partition.value}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.schema.names):
                yield pa.RecordBatch.from_arrays([batch.column(k.name).cast(k.type, safe=False) for k in kinds], schema=kinds)


class ChangeableWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, manifest: dict, overwrite: bool):
        self.path, self.manifest, self.overwrite, self.folder = path, manifest, overwrite, uuid.uuid4().hex
        self.target = T.StructType.fromJson(manifest["schema"])
        if schema.names != self.target.names:
            raise ValueError(f"columns {schema.names} for {self.target.names}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        folder, name = f"{root}/data/{self.folder}", f"part-{uuid.uuid4().hex}.parquet"
        system.create_dir(folder, recursive=True)
        kinds = to_arrow_schema(self.target)
        writer, rows = None, 0
        for b in batches:
            columns = [b.column(i).cast(k.type) for i, k in enumerate(kinds)]
            if missing := [k.name for k, c in zip(self.target.fields, columns) if not k.nullable and c.null_count]:
                raise Violation(f"columns {missing} cannot accept a null")
            if writer is None:
                writer = pq.ParquetWriter(f"{folder}/{name}", kinds, filesystem=system, coerce_timestamps="us")
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=kinds))
            rows += b.num_rows
        if writer is not None:
            writer.close()
        return Written(f"{self.folder}/{name}" if rows else "")

    def commit(self, messages: list) -> None:
        """The new version, created exclusively; nothing of another writer's is replaced."""
        new = [m.name for m in messages if m is not None and m.name]
        gone = self.manifest["files"] if self.overwrite else []
        version = self.manifest["version"] + 1
        kept = [] if self.overwrite else self.manifest["files"]
        text = manifest_text(version, self.manifest | {"operation": "overwrite" if self.overwrite else "append", "files": kept + new}, gone, new)
        system, root = file_system(self.path)
        name = f"{root}/versions/{version:09d}.json"
        if isinstance(system, fs.LocalFileSystem):
            try:
                with open(name, "x", encoding="utf-8") as f:
                    f.write(text)
            except FileExistsError:
                raise Conflict(f"{name} is there already") from None
            return
        if system.get_file_info(name).type != fs.FileType.NotFound:  # stores without an exclusive create: one writer at a time
            raise Conflict(f"{name} is there already")
        with system.open_output_stream(name) as f:
            f.write(text.encode())

    def abort(self, messages: list) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/data/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/data/{self.folder}")


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name
