"""Sources: external files, CSV import with bad records, JDBC, Kafka, tables from Python."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from itertools import islice

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from millrace.sources.writers import scratch

#: Storage letters and extensions of external tables by Spark's format.
FORMATS = {"P": "parquet", "O": "orc", "A": "avro", "T": "csv", "parquet": "parquet", "orc": "orc", "avro": "avro", "csv": "csv", "txt": "csv", "json": "json"}
CORRUPT = "_corrupt_record"
#: Rows of an iterator that the driver holds at once.
CHUNK = 100_000
#: Of rows from a database: bytes that the driver holds at once, and rows by which it adds to them.
CHUNK_BYTES, GROUP = 32 << 20, 1000


def read_external(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """An external table. kind: a storage letter (P, O, A, T), a format, or None for the path's extension (text as last
    resort). Without a schema it is inferred; mergeSchema unites the files' schemas."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.format(FORMATS.get(kind or ending, "csv")).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif FORMATS.get(kind or ending, "csv") == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.load(path)


def suggested_ddl(table: str, df: DataFrame, path: str, kind: str = "PARQUET", partition_by: list[str] | None = None) -> str:
    """The CREATE EXTERNAL TABLE statement that an inferred schema suggests."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in df.schema.fields)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    return f"CREATE EXTERNAL TABLE {table} ({columns}){parts} STORED AS {kind} LOCATION '{path}'"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


class TooManyBadRecords(Exception):
    pass


def import_csv(spark: SparkSession, path: str, schema: T.StructType, *, bad_path: str | None = None, allowed: int = -1, **options: str) -> DataFrame:
    """Permissive import: the good rows. Rows that do not parse, or lack a value where schema forbids null, are bad.

    bad_path: where the bad rows' text is written. allowed: most bad rows, -1 for any number; beyond it TooManyBadRecords.
    Quoted, multi-line and escaped values as Spark's CSV options say. Columns of the files beyond schema make a row bad.
    """
    wide = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.fields), T.StructField(CORRUPT, T.StringType(), True)])
    rows = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).schema(wide).csv(path)
    missing = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            missing = missing | F.col(f.name).isNull()
    bad = F.col(CORRUPT).isNotNull() | missing
    if bad_path is not None or allowed >= 0:
        text = F.coalesce(CORRUPT, F.to_csv(F.struct(*(f.name for f in schema.fields))))
        # every column takes part, so that a wrong value in any of them makes its row bad
        wrong = rows.withColumn("_all", F.struct(*rows.columns)).where(bad).select(text.alias("value"))
        if bad_path is not None:
            wrong.write.mode("overwrite").text(bad_path)
            wrong = spark.read.text(bad_path)
        if allowed >= 0 and (n := wrong.count()) > allowed:
            raise TooManyBadRecords(f"{n} bad records in {path}; {allowed} are allowed")
    return rows.where(~bad).drop(CORRUPT)


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of another database as a table. Give partitionColumn, lowerBound, upperBound and numPartitions, with dbtable
    in place of query, to read it in parallel."""
    source = {"query": query} if "partitionColumn" not in options else {"dbtable": f"({query}) q"}
    return spark.read.format("jdbc").options(url=url, **source, **options).load()


def _jdbc(spark: SparkSession, url: str, query: str, options: dict[str, str]) -> tuple:
    """Spark's own settings, dialect and connection for a database, on the driver."""
    jvm = spark._jvm
    given = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(url, f"({query}) q", jvm.PythonUtils.toScalaMap(options))
    dialect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    return given, dialect, dialect.createConnectionFactory(given).apply(-1)


def jdbc_connection(spark: SparkSession, url: str, **options: str) -> JavaObject:
    """A java.sql.Connection of the driver's; the caller closes it."""
    return _jdbc(spark, url, "-", options)[2]


def jdbc_query_by_driver(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """jdbc_query for a database that only the driver reaches, such as one embedded in its process. The query runs once, and
    now; more rows than one chunk holds (CHUNK rows, CHUNK_BYTES) go to files in the shared folder, a chunk at a time."""
    jvm, schema = spark._jvm, jdbc_query(spark, url, query, **options)._jdf.schema()
    given, dialect, connection = _jdbc(spark, url, query, options)
    try:
        dialect.beforeFetch(connection, jvm.PythonUtils.toScalaMap(options))
        statement = connection.createStatement()
        if given.sessionInitStatement().isDefined():
            statement.execute(given.sessionInitStatement().get())
        statement.setFetchSize(given.fetchSize())
        statement.setQueryTimeout(given.queryTimeout())
        result = statement.executeQuery(f"{given.prepareQuery()}{query}")
        # rows are made and grouped in the JVM: a call from Python for each value would take most of the time
        groups = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(result, schema, dialect).grouped(min(GROUP, CHUNK))
        path = None
        while True:
            rows, size = jvm.java.util.ArrayList(), 0
            while rows.size() < CHUNK and size < CHUNK_BYTES and groups.hasNext():
                group = groups.next()
                size += jvm.org.apache.spark.util.SizeEstimator.estimate(group)
                rows.addAll(jvm.scala.jdk.javaapi.CollectionConverters.asJavaCollection(group))
            chunk, last = DataFrame(spark._jsparkSession.createDataFrame(rows, schema), spark), not groups.hasNext()
            if path is None and last:
                return chunk
            path = path or scratch(spark, "jdbc")
            chunk.write.mode("append").parquet(path)
            if last:
                return spark.read.schema(chunk.schema).parquet(path)
            rows = group = chunk = None
            gc.collect()  # Python refers to Java objects in cycles, which would keep every chunk in the driver's memory
    finally:
        connection.close()


def kafka_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """All records of a topic from the earliest on, as key, value, partition, offset and ts. Needs Spark's Kafka package."""
    d = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest"}).load()
    return d.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", F.col("timestamp").alias("ts"))


def from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """An iterator of any length as a table: beyond CHUNK rows they go to files in the shared folder, a chunk at a time."""
    rows = iter(rows)
    first = list(islice(rows, CHUNK))
    if len(first) < CHUNK:
        return spark.createDataFrame(first, schema)
    path = scratch(spark, "rows")
    while first:
        chunk = spark.createDataFrame(first, schema)
        chunk.write.mode("append").parquet(path)
        first = list(islice(rows, CHUNK))
    return spark.read.schema(chunk.schema).parquet(path)


class NaturalNumbers(DataSource):
    """Python data source: n from 1 to the option `upto`, in `parts` partitions."""

    @classmethod
    def name(cls) -> str:
        return "natural_numbers"

    def schema(self) -> str:
        return "n bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NaturalNumbersReader(int(self.options.get("upto", "2048")), int(self.options.get("parts", "4")))


class _NaturalNumbersReader(DataSourceReader):
    def __init__(self, upto: int, parts: int):
        self.upto, self.parts = upto, parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i * self.upto // self.parts, (i + 1) * self.upto // self.parts)) for i in range(self.parts)]

    def read(self, partition: InputPartition | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # there are none
            return

        low, high = partition.value
        for at in range(low, high, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(range(at + 1, min(at + 10_000, high) + 1), pa.int64())], names=["n"])


class FilteredNumbers(NaturalNumbers):
    """NaturalNumbers that takes conditions on n: only partitions of numbers that can pass are made. Needs the setting
    spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "filtered_numbers"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FilteredNumbersReader(int(self.options.get("upto", "2048")), int(self.options.get("parts", "4")))


class _FilteredNumbersReader(_NaturalNumbersReader):
    def __init__(self, upto: int, parts: int):
        super().__init__(upto, parts)
        self.least, self.most = 1, upto

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds are used up; what else there is stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("n",) and isinstance(f.value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif not isinstance(f, IsNotNull):
                yield f

    def partitions(self) -> list[InputPartition]:
        many = max(0, self.most - self.least + 1)
        return [InputPartition((self.least - 1 + i * many // self.parts, self.least - 1 + (i + 1) * many // self.parts)) for i in range(self.parts)] if many else []


def from_rdd(rdd, schema: T.StructType | str) -> DataFrame:
    """An RDD of rows as a table."""
    return SparkSession.active().createDataFrame(rdd, schema)


def refresh(spark: SparkSession, path: str) -> None:
    """Forget what is known of the files below path."""
    spark.catalog.refreshByPath(path)


def is_pinned(df: DataFrame) -> bool:
    """Whether the table is kept in memory."""
    return df.storageLevel.useMemory
