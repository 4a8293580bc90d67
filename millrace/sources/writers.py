"""Sinks: file export, external tables, bulk load, Kafka."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import ensure_checkpoint_dir

#: Quote modes of an export by whether all values are quoted.
QUOTE_MODES = {"DEFAULT": False, "MINIMAL": False, "ALWAYS": True, "ALL": True}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def unquoted(argument: str | None) -> str | None:
    if argument is None or argument.strip().lower() == "null":
        return None
    text = argument.strip()
    return text[1:-1].replace("''", "'") if text.startswith("'") else text


def export_files(
    df: DataFrame, path: str, compression: str | None = None, replication: str | None = None, encoding: str | None = None, separator: str | None = None, quote: str | None = None,
    quote_mode: str | None = None, kind: str | None = None, floats: str | None = None, timestamps: str | None = None,
) -> DataFrame:
    """EXPORT(path, compression, replication, encoding, fieldSeparator, quoteCharacter, quoteMode, format,
    floatingPointNotation, timestampFormat): arguments as written in SQL; the path's content is replaced.

    Formats: csv (default), parquet, orc, json. Compression: true or gz, bz2, zstd, snappy, none. The replication factor
    is the file system's own. Result: one row with exported_rows.
    """
    path, compression, encoding = unquoted(path), unquoted(compression), unquoted(encoding)
    kind = (unquoted(kind) or "csv").lower()
    codec = {"true": "gzip", "gz": "gzip", "bz2": "bzip2", "false": None}.get((compression or "false").lower(), compression)
    counted = Observation()
    out = df.observe(counted, F.count(F.lit(1)).alias("n"))  # counted while it is written
    if (unquoted(floats) or "").lower() == "plain" and kind == "csv":
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                out = out.withColumn(f.name, F.col(f.name).cast("decimal(38,9)").cast("string"))
    writer = out.write.mode("overwrite")
    if codec:
        writer = writer.option("compression", codec)
    if kind == "csv":
        every = QUOTE_MODES.get((unquoted(quote_mode) or "DEFAULT").upper(), False)
        writer = writer.options(sep=unquoted(separator) or ",", quote=unquoted(quote) or '"', escape=unquoted(quote) or '"', quoteAll=str(every).lower(), encoding=encoding or "UTF-8", emptyValue='""', header="false")
        if stamp := unquoted(timestamps):
            writer = writer.options(timestampFormat=stamp, timestampNTZFormat=stamp)
    writer.format(kind).save(path)
    return df.sparkSession.createDataFrame([(counted.get.get("n", 0),)], "exported_rows bigint")


def write_external(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, compression: str | None = None, mode: str = "overwrite") -> None:
    """An external table's files: parquet, orc, avro (where the package is there), csv or json, by partition folders."""
    writer = df.write.mode(mode).format(kind)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def create_empty(spark: SparkSession, schema: T.StructType, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """The files of an empty external table."""
    write_external(spark.createDataFrame([], schema), path, kind, partition_by)


def bulk_load(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Files in key order, ranges of keys per file: row groups with narrow statistics that scans can skip."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def bucketed_table(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by keys: joins on them need no shuffle. It stands in for an index on keys."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def kafka_records(df: DataFrame, key: str | None = None) -> DataFrame:
    """What is sent of each row: its JSON as value, and the key column's text, where there is one."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def records_to_rows(records: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of records as kafka_records makes them, whose value is JSON; a value that is none gives a row of nulls."""
    return records.select(F.from_json(F.col("value").cast("string"), schema).alias("row")).select("row.*")


def export_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """EXPORT_KAFKA: the records of kafka_records to a topic. Needs Spark's Kafka package on the class path."""
    kafka_records(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
