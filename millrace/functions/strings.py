"""String functions with the semantics of the SQL dialect where Spark's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regexp_like(s: ColumnOrName, pattern: str) -> Column:
    """Whole-string, case-insensitive match, to the last line break; a null subject is false."""
    return F.coalesce(_c(s).rlike(rf"(?i)\A(?:{pattern})\z"), F.lit(False))


def instr0(hay: ColumnOrName, needle: ColumnOrName) -> Column:
    """1-based place of needle; 0 if either is null or needle is empty."""
    return F.coalesce(F.when(F.length(_c(needle)) == 0, 0).otherwise(F.position(_c(needle), _c(hay))), F.lit(0)).cast("int")


def locate(needle: ColumnOrName, hay: ColumnOrName, start: int = 1) -> Column:
    return F.position(_c(needle), _c(hay), F.lit(start))


def posstr(hay: ColumnOrName, needle: ColumnOrName) -> Column:
    return F.position(_c(needle), _c(hay))


def rtrim_ws(s: ColumnOrName) -> Column:
    """Strips every kind of trailing white space."""
    return F.regexp_replace(_c(s), r"\s+$", "")


def chr256(i: ColumnOrName) -> Column:
    """Character of a code: below zero character 255, from 256 on the remainder by 256."""
    i = _c(i).cast("bigint")
    return F.char(F.when(i < 0, F.lit(255).cast("bigint")).otherwise(i % 256))


def translate(s: ColumnOrName, to: str, source: str, pad: str = " ") -> Column:
    """(expression, to, from, pad): a longer `to` is cut, a shorter one filled with pad."""
    return F.translate(_c(s), source, to[: len(source)].ljust(len(source), pad))


def digits(x: ColumnOrName, width: int) -> Column:
    """Digits of the absolute value, without sign and point, filled with zeros."""
    return F.lpad(F.regexp_replace(F.abs(_c(x)).cast("string"), r"\.", ""), width, "0")


def hex_utf8(s: ColumnOrName) -> Column:
    return F.hex(F.encode(_c(s), "UTF-8"))


def char_pad(s: ColumnOrName, n: int) -> Column:
    """CHAR(n): filled with blanks, cut to n."""
    return F.rpad(_c(s), n, " ")


def char_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Comparison of CHAR values: trailing blanks do not count."""
    return F.rtrim(_c(a)) == F.rtrim(_c(b))


def string_agg(x: ColumnOrName, separator: str = ",", order: bool = True) -> Column:
    """Joined non-null values, sorted unless order is false; null for none."""
    values = F.collect_list(_c(x).cast("string"))
    joined = F.array_join(F.array_sort(values) if order else values, separator)
    return F.when(F.size(values) > 0, joined)


#: Letters whose case the Turkic locales change.
TURKIC = [("i", "İ"), ("ı", "I")]


def upper_in(s: ColumnOrName, locale: str) -> Column:
    """UPPER(s, locale); only the Turkic locales (tr, az) differ from the root one."""
    s = _c(s)
    if locale.lower()[:2] in ("tr", "az"):
        s = F.translate(s, "".join(a for a, _ in TURKIC), "".join(b for _, b in TURKIC))
    return F.upper(s)


def lower_in(s: ColumnOrName, locale: str) -> Column:
    """LOWER(s, locale)."""
    s = _c(s)
    if locale.lower()[:2] in ("tr", "az"):
        s = F.translate(s, "".join(b for _, b in TURKIC), "".join(a for a, _ in TURKIC))
    return F.lower(s)


def split_part(s: ColumnOrName, separator: str, n: int) -> Column:
    return F.split_part(_c(s), F.lit(separator), F.lit(n))


def initcap(s: ColumnOrName) -> Column:
    """First letter of each word in upper case, the rest in lower case."""
    return F.initcap(_c(s))


def trim_chars(s: ColumnOrName, chars: str = " ", side: str = "both") -> Column:
    """TRIM([BOTH | LEADING | TRAILING] chars FROM s)."""
    f = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side]
    return f(_c(s), F.lit(chars))
