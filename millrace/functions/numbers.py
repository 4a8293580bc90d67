"""Numeric functions with the semantics of the SQL dialect where Spark's differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import ColumnOrName, _c


def trunc_num(x: ColumnOrName, places: int = 0) -> Column:
    """TRUNC(number, places): towards zero; negative places cut before the point. Decimals stay exact."""
    factor = F.lit(10**places if places >= 0 else 1)
    if places >= 0:
        return F.signum(_c(x)).cast("decimal(1,0)") * F.floor(F.abs(_c(x)) * factor) / factor
    step = F.lit(10**-places)
    return F.signum(_c(x)).cast("decimal(1,0)") * F.floor(F.abs(_c(x)) / step) * step


def pow_checked(x: ColumnOrName, y: ColumnOrName) -> Column:
    """POWER that raises where the result is no finite number."""
    p = F.pow(_c(x).cast("double"), _c(y).cast("double"))
    bad = F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("The resulting value is outside the range for the data type DOUBLE"))).otherwise(p)


def multiply_alt(a: ColumnOrName, b: ColumnOrName, precision: int = 31, scale: int = 6) -> Column:
    """Decimal product with stated precision and scale."""
    return (_c(a) * _c(b)).cast(f"decimal({precision},{scale})")


def decimal_of(x: ColumnOrName, precision: int, scale: int = 0, point: str = ".") -> Column:
    """DECIMAL(x, p, s, character): from a number, or from a string with another decimal character."""
    x = _c(x)
    return (F.replace(x, F.lit(point), F.lit(".")) if point != "." else x).cast(f"decimal({precision},{scale})")


#: Precision of DECIMAL(x) by the type of x, and scale where it is not 0.
PRECISIONS = {"tinyint": (5, 0), "smallint": (5, 0), "int": (11, 0), "bigint": (19, 0), "decimal": (15, 0), "float": (15, 0), "double": (15, 0), "string": (15, 0), "date": (8, 0), "time": (6, 0), "timestamp": (20, 6)}


def decimal_by_type(df: DataFrame, name: str, precision: int | None = None, scale: int | None = None, point: str = ".") -> Column:
    """DECIMAL(x [, p [, s [, character]]]) of a column, with the precision of its type unless given.

    Numbers are cut, not rounded. A date counts as yyyymmdd, a time as hhmmss, a timestamp as yyyymmddhhmmss.ffffff; a
    precision too small for them is refused.
    """
    kind = df.schema[name].dataType.simpleString().split("(")[0].removesuffix("_ntz").replace("varchar", "string").replace("char", "string")
    if kind not in PRECISIONS:
        raise TypeError(f"DECIMAL of {kind}")
    p, s = PRECISIONS[kind]
    if kind in ("date", "time", "timestamp") and (precision or p) - (scale if scale is not None else s) < p - s:
        raise ValueError(f"DECIMAL({precision}) of a {kind}")
    p, s = precision or p, s if scale is None else scale
    x = _c(name)
    if kind == "string":
        x = F.trim(F.replace(x, F.lit(point), F.lit(".")) if point != "." else x).cast("decimal(38,10)")
    elif kind == "date":
        x = F.date_format(x, "yyyyMMdd")
    elif kind == "timestamp":
        x = F.date_format(x, "yyyyMMddHHmmss.SSSSSS")
    elif kind == "time":
        x = F.hour(x) * 10000 + F.minute(x) * 100 + F.floor(F.second(x)).cast("int")
    if kind in ("decimal", "float", "double", "string"):
        exact = x.cast("decimal(38,10)")
        x = F.signum(exact).cast("decimal(1,0)") * F.floor(F.abs(exact) * F.lit(10**s)) / F.lit(10**s)
    return x.cast(f"decimal({p},{s})")


def scalar_min(*x: ColumnOrName) -> Column:
    """MIN of its arguments in the row; null if any is null."""
    return F.when(reduce(lambda a, b: a | b, (_c(c).isNull() for c in x)), None).otherwise(F.least(*map(_c, x)))


def scalar_max(*x: ColumnOrName) -> Column:
    """MAX of its arguments in the row; null if any is null."""
    return F.when(reduce(lambda a, b: a | b, (_c(c).isNull() for c in x)), None).otherwise(F.greatest(*map(_c, x)))


def int_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Division of integers: truncated towards zero, an error for zero."""
    return F.call_function("div", _c(a).cast("bigint"), _c(b).cast("bigint"))


def sum_exact(x: ColumnOrName) -> Column:
    """SUM of integers that cannot overflow."""
    return F.sum(_c(x).cast("decimal(38,0)"))
