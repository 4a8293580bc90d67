"""Type, id, array, XML and session functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.strings import ColumnOrName, _c
from millrace.session import ensure_checkpoint_dir


def blob(x: ColumnOrName) -> Column:
    return _c(x).cast("binary")


def typeof(x: ColumnOrName) -> Column:
    return F.typeof(_c(x))


def long_uuid() -> Column:
    """A random 64-bit id; differs between runs."""
    return F.xxhash64(F.expr("uuid()"))


def array_of(*x: ColumnOrName) -> Column:
    return F.array(*map(_c, x))


def array_element(a: ColumnOrName, i: int) -> Column:
    """The i-th element from 1; null beyond the end."""
    return F.get(_c(a), F.lit(i - 1))


def xml_query(xml: ColumnOrName, path: str) -> Column:
    """XMLQUERY with XMLSERIALIZE: the text at a path, null where the document is null."""
    return F.xpath_string(_c(xml), F.lit(path))


def xml_exists(xml: ColumnOrName, path: str) -> Column:
    return F.xpath_boolean(_c(xml), F.lit(path))


def xml_parse(xml: ColumnOrName, schema: str) -> Column:
    """XMLPARSE into a struct of the given DDL schema."""
    return F.from_xml(_c(xml), schema)


def with_sequence(df: DataFrame, column: str, order: list[Column], start: int = 1, step: int = 1) -> DataFrame:
    """NEXT VALUE FOR: gap-free numbers in a stated order.

    A range sort, kept in a checkpoint so that its borders are drawn once, numbers each partition; the partitions' sizes,
    a row each, give the offsets. No single task sees all rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.withColumn("_nth", F.row_number().over(inside).cast("bigint"))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(offsets, "_part")
    return joined.withColumn(column, F.lit(start).cast("bigint") + (F.col("_before") + F.col("_nth") - 1) * step).drop("_part", "_nth", "_before")


#: Length of a value that its type alone decides.
LENGTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "time": 3, "timestamp": 10}


def length_by_type(df: DataFrame, name: str) -> Column:
    """LENGTH of any type: bytes of numbers and times by their type, the declared length of CHAR(n), characters of other
    texts, bytes of binaries; null for null."""
    field = df.schema[name]
    kind = field.dataType.simpleString().split("(")[0].removesuffix("_ntz")
    value = F.col(name)
    declared = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "") if field.metadata else ""
    if declared.startswith("char("):
        length = F.lit(int(declared[5:-1]))
    elif kind == "decimal":
        length = F.lit(field.dataType.precision // 2 + 1)
    elif kind in LENGTHS:
        length = F.lit(LENGTHS[kind])
    else:
        return F.length(value)
    return F.when(value.isNotNull(), length)


def java_static(class_name: str, method: str, *arguments: ColumnOrName) -> Column:
    """The text of what a static Java method gives for the arguments; the class must be on the class path."""
    return F.reflect(F.lit(class_name), F.lit(method), *map(_c, arguments))


def map_of(keys: ColumnOrName, values: ColumnOrName) -> Column:
    """A map from two arrays; of equal keys the last one stays."""
    entries = F.arrays_zip(_c(keys).alias("k"), _c(values).alias("v"))
    last = lambda e: F.array_max(F.transform(F.filter(F.transform(entries, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"))), lambda x: x["k"] == e), lambda x: x["i"]))
    distinct = F.array_distinct(_c(keys))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda e: F.get(_c(values), last(e))))


def session_value(spark: SparkSession, name: str) -> str | None:
    """CURRENT SCHEMA, USER, ROLE, SERVER, ISOLATION, GROUP_USER and session properties by name.

    The role and the groups are what the session properties millrace.role and millrace.groups say. Isolation is that of
    changeable tables: a reader sees one version.
    """
    plain = name.upper().replace("_", " ")
    if plain == "CURRENT SERVER":
        return spark.catalog.currentCatalog()
    if plain == "CURRENT ISOLATION":
        return "SNAPSHOT"
    if plain in ("CURRENT ROLE", "GROUP USER"):
        return spark.conf.get("millrace.role" if plain == "CURRENT ROLE" else "millrace.groups", None)
    if name.upper() in ("CURRENT SCHEMA", "CURRENT_SCHEMA"):
        return spark.catalog.currentDatabase()
    if name.upper() in ("CURRENT_USER", "USER", "SESSION_USER", "SYSTEM_USER"):
        return spark.range(1).select(F.current_user()).first()[0]
    return spark.conf.get(name, None)
