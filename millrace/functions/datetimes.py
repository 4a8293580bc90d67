"""Date and time functions of the SQL dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import ColumnOrName, _c


def days(d: ColumnOrName) -> Column:
    """DAYS: 1 for 0001-01-01."""
    return F.datediff(_c(d), F.lit("0001-01-01").cast("date")) + 1


def monthname(d: ColumnOrName) -> Column:
    return F.date_format(_c(d), "MMMM")


def weekdayname(d: ColumnOrName) -> Column:
    return F.date_format(_c(d), "EEEE")


def weekday(d: ColumnOrName) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(_c(d)) + 1


def second_fraction(t: ColumnOrName) -> Column:
    """SECOND with its fraction, as decimal(8,6)."""
    return F.extract(F.lit("SECOND"), _c(t))


def second_of(df: DataFrame, name: str, scale: int | None = None, compatibility: str = "") -> Column:
    """SECOND(x [, scale]) of a time or timestamp column, of a type that the compatibility property decides: without it int
    for a time and double with the fraction for a timestamp; with "db2" int, or given a scale decimal(2+scale, scale), cut."""
    kind, exact = df.schema[name].dataType.simpleString(), F.extract(F.lit("SECOND"), F.col(name))
    if not kind.startswith("time"):
        raise TypeError(f"SECOND of {kind}")
    if compatibility.lower() != "db2":
        if scale is not None:
            raise TypeError("SECOND takes one operand")
        return exact.cast("double") if kind.startswith("timestamp") else F.floor(exact).cast("int")
    if scale is None:
        return F.floor(exact).cast("int")
    return (F.floor(exact * 10**scale) / F.lit(10**scale)).cast(f"decimal({2 + scale},{scale})")


def timestamp_of(d: ColumnOrName, time: ColumnOrName) -> Column:
    """TIMESTAMP(date, time), time as text HH:mm:ss."""
    return F.to_timestamp_ntz(F.concat_ws(" ", _c(d).cast("string"), _c(time)))


def add_days(d: ColumnOrName, n: ColumnOrName | int) -> Column:
    return F.date_add(_c(d), F.lit(n) if isinstance(n, int) else _c(n))


def add_months(d: ColumnOrName, n: ColumnOrName | int) -> Column:
    return F.add_months(_c(d), F.lit(n) if isinstance(n, int) else _c(n))


def add_years(d: ColumnOrName, n: ColumnOrName | int) -> Column:
    return F.add_months(_c(d), (F.lit(n) if isinstance(n, int) else _c(n)) * 12)


def timestampadd(unit: str, n: int, t: str) -> Column:
    """{fn TIMESTAMPADD(unit, n, t)}; unit with or without SQL_TSI_."""
    return F.expr(f"timestampadd({unit.upper().removeprefix('SQL_TSI_')}, {n}, {t})")


def timestampdiff(unit: str, a: str, b: str) -> Column:
    return F.expr(f"timestampdiff({unit.upper().removeprefix('SQL_TSI_')}, {a}, {b})")


def trunc_date(d: ColumnOrName, unit: str) -> Column:
    """TRUNC of a date, as a date."""
    return F.trunc(_c(d), unit)


def trunc_time(t: ColumnOrName, unit: str) -> Column:
    """TRUNC of a timestamp."""
    return F.date_trunc(unit, _c(t))


def to_instant(t: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 UTC."""
    return F.unix_micros(_c(t).cast("timestamp"))
