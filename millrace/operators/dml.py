"""INSERT, UPDATE, DELETE, upsert and constraints as rewrites: each returns the new content of the target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize(source: DataFrame, target: T.StructType) -> DataFrame:
    """source, column by position, cast to the target's types; raises at run time for a null where target forbids it and
    for a string longer than a char or varchar target."""
    if len(source.columns) != len(target):
        raise ValueError(f"{len(source.columns)} columns for {len(target)}")
    out = []
    for name, field in zip(source.columns, target.fields):
        value = F.col(f"`{name}`")
        if isinstance(field.dataType, (T.CharType, T.VarcharType)):
            long = F.length(F.rtrim(value.cast("string"))) > field.dataType.length
            value = F.when(long, F.raise_error(F.lit(f"value too long for {field.name}"))).otherwise(value.cast("string"))
            value = F.rpad(value, field.dataType.length, " ") if isinstance(field.dataType, T.CharType) else value
        else:
            value = value.cast(field.dataType)
        if not field.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"column {field.name} cannot accept a null")).cast(value_type(field))).otherwise(value)
        out.append(value.alias(field.name))
    return source.select(*out)


def value_type(field: T.StructField) -> T.DataType:
    return T.StringType() if isinstance(field.dataType, (T.CharType, T.VarcharType)) else field.dataType


def aligned_rows(schema: T.StructType, source: DataFrame, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None) -> DataFrame:
    """source's rows in schema's columns and types. Columns that source lacks take their default or null; generated ones
    are computed."""
    defaults, own = defaults or {}, set(source.columns)
    kinds = {f.name: f.dataType for f in schema.fields}
    rows = source.select(*((F.col(c) if c in own else defaults.get(c, F.lit(None))).cast(k).alias(c) for c, k in kinds.items()))
    return rows.withColumns({c: e.cast(kinds[c]) for c, e in generated.items()}) if generated else rows


def insert_rows(target: DataFrame, source: DataFrame, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None) -> DataFrame:
    """target with source's rows, see aligned_rows."""
    return target.unionAll(aligned_rows(target.schema, source, defaults, generated))


def update_rows(target: DataFrame, where: Column, **new: Column) -> DataFrame:
    """Rows for which where is true take the new values, all computed from the old row."""
    hit = F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in target.schema.fields}
    return target.withColumns({c: F.when(hit, e.cast(kinds[c])).otherwise(F.col(c)) for c, e in new.items()})


def delete_rows(target: DataFrame, where: Column) -> DataFrame:
    """Rows for which where is not true: those for which it is null stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace those of target with equal keys, others are added. Null keys are keys.

    source must be unique by keys; see duplicate_keys. An anti-join and a union: source's rows are not touched by the join.
    """
    s = source.select(*target.columns)
    on = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return target.alias("t").join(s.alias("s"), on, "left_anti").select(*target.columns).unionAll(s)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of target's rows taken from the row of source with equal keys, where there is one."""
    s = source.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = target.join(s, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_k_{k}") for k in keys)), "left")
    kept = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*(kept[c].alias(c) if c in kept else F.col(c) for c in target.columns))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of UNIQUE or PRIMARY KEY: keys, all non-null, with more than one row, and their number."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_parents(child: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """Violations of a foreign key: distinct non-null references without a parent."""
    refs = child.where(F.col(reference).isNotNull()).select(reference).distinct()
    return refs.join(parent.select(F.col(key).alias(reference)), reference, "left_anti")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Violations of CHECK: rows for which the condition is false (null passes)."""
    return df.where(~F.coalesce(condition, F.lit(True)))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Violations of NOT NULL."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def enforced(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which raises while it is read if the condition is false for a row."""
    first = df.columns[0]
    bad = ~F.coalesce(condition, F.lit(True))
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit(message)).cast(df.schema[first].dataType)).otherwise(F.col(first)))
