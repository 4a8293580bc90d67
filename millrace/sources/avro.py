"""Avro object container files as a Python data source, for clusters without Spark's Avro package.

Reads and writes null, boolean, int, long, float, double, string, bytes, date, timestamps, arrays, maps with string keys,
records and optional values, with the codecs null, deflate and zstandard. Files are split at their sync markers, about
SPLIT_BYTES to a task. Paths are folders that all executors share, or URLs of what pyarrow's file systems know (s3, hdfs,
gs and others). Decoding is row by row in Python: prefer Parquet where there is a choice, or Spark's own package.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"Obj\x01"
SPLIT_BYTES = 32 << 20
BLOCK_ROWS = 4000
EPOCH = dt.datetime(1970, 1, 1)

#: Avro's types, with their logical type, by Spark's.
TYPES = [
    ("null", None, T.NullType()), ("boolean", None, T.BooleanType()), ("int", None, T.IntegerType()), ("long", None, T.LongType()), ("float", None, T.FloatType()), ("double", None, T.DoubleType()), ("string", None, T.StringType()),
    ("bytes", None, T.BinaryType()), ("int", "date", T.DateType()), ("long", "timestamp-micros", T.TimestampType()), ("long", "local-timestamp-micros", T.TimestampNTZType()),
]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


def spark_type(schema) -> tuple[T.DataType, bool]:
    """Spark's type of an Avro schema, and whether it can be null."""
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError(f"a union of {len(rest)} types")
        return spark_type(rest[0])[0], "null" in schema
    kind, logical = (schema["type"], schema.get("logicalType")) if isinstance(schema, dict) else (schema, None)
    if kind == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in schema["fields"]]), False
    if kind == "array":
        return T.ArrayType(*spark_type(schema["items"])), False
    if kind == "map":
        return T.MapType(T.StringType(), *spark_type(schema["values"])), False
    for name, known, spark in TYPES:
        if name == kind and known == logical:
            return spark, kind == "null"
    for name, known, spark in TYPES:
        if name == kind and known is None:
            return spark, False
    raise ValueError(f"unknown type {schema}")


def avro_schema(kind: T.DataType, nullable: bool, name: str = "row"):
    """Avro's schema of one of Spark's types."""
    if isinstance(kind, T.StructType):
        out = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_schema(f.dataType, f.nullable, f"{name}_{f.name}")} for f in kind.fields]}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": avro_schema(kind.elementType, kind.containsNull, f"{name}_item")}
    elif isinstance(kind, T.MapType):
        out = {"type": "map", "values": avro_schema(kind.valueType, kind.valueContainsNull, f"{name}_value")}
    else:
        wide = {T.ByteType(): T.IntegerType(), T.ShortType(): T.IntegerType()}.get(kind, kind)
        found = next(((n, logical) for n, logical, spark in TYPES if spark == wide), None)
        if found is None:
            raise ValueError(f"{kind.simpleString()} has no counterpart here")
        out = {"type": found[0], "logicalType": found[1]} if found[1] else found[0]
    return ["null", out] if nullable and out != "null" else out


def read_long(f: io.BufferedIOBase) -> int:
    shift = out = 0
    while True:
        b = f.read(1)[0]
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return (out >> 1) ^ -(out & 1)
        shift += 7


def long_bytes(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def decoder(schema) -> Callable[[io.BytesIO], object]:
    if isinstance(schema, list):
        branches = [decoder(s) for s in schema]
        return lambda f: branches[read_long(f)](f)
    kind, logical = (schema["type"], schema.get("logicalType")) if isinstance(schema, dict) else (schema, None)
    if kind == "record":
        fields = [decoder(x["type"]) for x in schema["fields"]]
        return lambda f: tuple(d(f) for d in fields)
    if kind in ("array", "map"):
        item = decoder(schema["items" if kind == "array" else "values"])
        text = decoder("string")

        def blocks(f: io.BytesIO) -> Iterator:
            while n := read_long(f):
                if n < 0:
                    n, _ = -n, read_long(f)
                for _ in range(n):
                    yield item(f) if kind == "array" else (text(f), item(f))

        return (lambda f: list(blocks(f))) if kind == "array" else (lambda f: dict(blocks(f)))
    if kind == "long" and logical in ("timestamp-micros", "local-timestamp-micros"):
        zone = dt.timezone.utc if logical == "timestamp-micros" else None
        return lambda f: (EPOCH + dt.timedelta(microseconds=read_long(f))).replace(tzinfo=zone)
    if kind == "int" and logical == "date":
        return lambda f: (EPOCH + dt.timedelta(read_long(f))).date()
    return {
        "null": lambda f: None, "boolean": lambda f: f.read(1) == b"\x01", "int": read_long, "long": read_long, "float": lambda f: struct.unpack("<f", f.read(4))[0], "double": lambda f: struct.unpack("<d", f.read(8))[0],
        "string": lambda f: f.read(read_long(f)).decode(), "bytes": lambda f: f.read(read_long(f)),
    }[kind]


def encoder(schema) -> Callable[[object], bytes]:
    if isinstance(schema, list):
        inner = encoder(schema[1])
        return lambda v: b"\x00" if v is None else b"\x02" + inner(v)
    kind, logical = (schema["type"], schema.get("logicalType")) if isinstance(schema, dict) else (schema, None)
    if kind == "record":
        fields = [encoder(x["type"]) for x in schema["fields"]]
        return lambda v: b"".join(e(x) for e, x in zip(fields, v))
    if kind == "array":
        item = encoder(schema["items"])
        return lambda v: (long_bytes(len(v)) + b"".join(map(item, v)) if v else b"") + b"\x00"
    if kind == "map":
        value, text = encoder(schema["values"]), encoder("string")
        return lambda v: (long_bytes(len(v)) + b"".join(text(k) + value(x) for k, x in v.items()) if v else b"") + b"\x00"
    if logical == "date":
        return lambda v: long_bytes((v - EPOCH.date()).days)
    if logical:
        return lambda v: long_bytes(round((v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo or logical == "timestamp-micros" else v).__sub__(EPOCH) / dt.timedelta(microseconds=1)))
    text = lambda b: long_bytes(len(b)) + bytes(b)
    return {
        "null": lambda v: b"", "boolean": lambda v: b"\x01" if v else b"\x00", "int": long_bytes, "long": long_bytes, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v),
        "string": lambda v: text(v.encode()), "bytes": text,
    }[kind]


def unpacked(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec != "null":
        raise ValueError(f"codec {codec}")
    return data


def packed(codec: str, data: bytes) -> bytes:
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        return c.compress(data) + c.flush()
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    if codec != "null":
        raise ValueError(f"codec {codec}")
    return data


def header(f: io.BufferedIOBase) -> tuple[dict[str, bytes], bytes]:
    """The file's metadata and sync marker; f is left at the first block."""
    if f.read(4) != MAGIC:
        raise ValueError("no Avro object container file")
    meta = decoder({"type": "map", "values": "bytes"})(f)
    return meta, f.read(16)


def files_of(path: str) -> list[tuple[str, int]]:
    """Name, in its file system, and size of each file below path."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".avro") and not f.base_name.startswith(("_", ".")))


class AvroSource(DataSource):
    """spark.read.format("avro_files").load(folder), df.write.format("avro_files").option("codec", "deflate").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "avro_files"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no .avro files below {self.options['path']}")
        with file_system(self.options["path"])[0].open_input_file(files[0][0]) as f:
            return spark_type(json.loads(header(f)[0]["avro.schema"]))[0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return AvroReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return AvroWriter(self.options["path"], schema, self.options.get("codec", "deflate"), overwrite)


class AvroReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, size in files_of(self.path):
            out += [InputPartition((name, size, low, min(size, low + SPLIT_BYTES))) for low in range(0, size, SPLIT_BYTES)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Blocks whose preceding sync marker ends in (low, high]; the first block belongs to the first split."""
        name, size, low, high = partition.value
        with file_system(self.path)[0].open_input_file(name) as f:
            meta, sync = header(f)
            codec, schema = meta.get("avro.codec", b"null").decode(), json.loads(meta["avro.schema"])
            decode = decoder(schema)
            names = [x["name"] for x in schema["fields"]]
            places = [names.index(n) if n in names else None for n in self.names]
            first = f.tell()
            at = first if low < first else self._after_sync(f, sync, max(low - 16, first - 16))
            while at is not None and at < size and (at <= high or at == first):
                f.seek(at)
                rows, length = read_long(f), read_long(f)
                block = io.BytesIO(unpacked(codec, f.read(length)))
                for _ in range(rows):
                    row = decode(block)
                    yield tuple(row[p] if p is not None else None for p in places)
                f.read(16)
                at = f.tell()

    @staticmethod
    def _after_sync(f: io.BufferedIOBase, sync: bytes, at: int) -> int | None:
        """The end of the first marker that ends after at + 16."""
        f.seek(at + 1)
        held, begin = b"", at + 1
        while more := f.read(1 << 20):
            held += more
            if (k := held.find(sync)) >= 0:
                return begin + k + 16
            begin += len(held) - 15 if len(held) > 15 else 0
            held = held[-15:] if len(held) > 15 else held
        return None


class AvroWriter(DataSourceWriter):
    """A file per task, under its final name only when all are complete; an overwrite removes the files before it then."""

    def __init__(self, path: str, schema: T.StructType, codec: str, overwrite: bool):
        self.path, self.codec, self.overwrite, self.staging = path, codec, overwrite, f"_{uuid.uuid4().hex}"
        self.schema = avro_schema(schema, False)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = file_system(self.path)
        folder = f"{folder.rstrip('/')}/{self.staging}"
        system.create_dir(folder, recursive=True)
        encode, sync = encoder(self.schema), uuid.uuid4().bytes
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        meta = {"avro.schema": json.dumps(self.schema).encode(), "avro.codec": self.codec.encode()}
        with system.open_output_stream(hidden) as f:
            f.write(MAGIC + encoder({"type": "map", "values": "bytes"})(meta) + sync)
            held: list[bytes] = []

            def flush() -> None:
                data = packed(self.codec, b"".join(held))
                f.write(long_bytes(len(held)) + long_bytes(len(data)) + data + sync)
                held.clear()

            for row in rows:
                held.append(encode(row))
                if len(held) == BLOCK_ROWS:
                    flush()
            if held:
                flush()
        return AvroCommit(hidden)

    def commit(self, messages: list) -> None:
        system, folder = file_system(self.path)
        before = files_of(self.path) if self.overwrite else []
        for i, m in enumerate(messages):
            if m is not None:
                system.move(m.name, f"{folder.rstrip('/')}/part-{i:05d}-{uuid.uuid4().hex[:8]}.avro")
        for name, _ in before:
            system.delete_file(name)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = file_system(self.path)
        staging = f"{folder.rstrip('/')}/{self.staging}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class AvroCommit(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name
