"""Scalar functions at their edges."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import datetimes as D
from millrace.functions import misc as M
from millrace.functions import numbers as N
from millrace.functions import strings as S


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def text(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: S.regexp_like(text("ABC"), "a.c"), True), (lambda: S.regexp_like(text("xABC"), "a.c"), False), (lambda: S.regexp_like(text(None), "a"), False), (lambda: S.regexp_like(text("abc\n"), "abc"), False), (lambda: S.regexp_like(text("abc\n"), "abc\\s|x"), True),
        (lambda: S.instr0(text("hay"), text("")), 0), (lambda: S.instr0(text(None), text("a")), 0), (lambda: S.instr0(text("hay"), text("y")), 3),
        (lambda: S.rtrim_ws(text("a \t\n")), "a"), (lambda: S.chr256(F.lit(-1)), "ÿ"), (lambda: S.chr256(F.lit(256 + 65)), "A"),
        (lambda: S.translate(text("ABC"), "a", "AB"), "a C"), (lambda: S.translate(text("ABC"), "abx", "AB"), "abC"), (lambda: S.digits(F.lit(Decimal("-12.5")), 6), "000125"),
        (lambda: S.upper_in(text("iı"), "tr"), "İI"), (lambda: S.lower_in(text("Iİ"), "az"), "ıi"), (lambda: S.lower_in(text("I"), "en"), "i"), (lambda: S.hex_utf8(text("é")), "C3A9"),
        (lambda: S.char_equal(text("a  "), text("a")), True), (lambda: S.split_part(text("a,b"), ",", 3), ""), (lambda: S.initcap(text("aB cD")), "Ab Cd"),
        (lambda: N.trunc_num(F.lit(Decimal("-1.29")), 1).cast("double"), -1.2), (lambda: N.trunc_num(F.lit(1299), -2).cast("int"), 1200), (lambda: N.pow_checked(F.lit(2), F.lit(10)), 1024.0),
        (lambda: N.scalar_min(F.lit(1), F.lit(None).cast("int")), None), (lambda: N.scalar_max(F.lit(1), F.lit(2)), 2), (lambda: N.decimal_of(text("1,5"), 5, 2, ","), Decimal("1.50")),
        (lambda: N.int_divide(F.lit(-7), F.lit(2)), -3), (lambda: N.int_divide(F.lit(2**63 - 1), F.lit(1)), 2**63 - 1), (lambda: N.multiply_alt(F.lit(Decimal("1.5")), F.lit(Decimal("2.5")), 10, 3), Decimal("3.750")),
        (lambda: D.days(text("0001-01-01").cast("date")), 1), (lambda: D.days(F.lit(dt.date(2020, 1, 1))), 737425), (lambda: D.monthname(F.lit(dt.date(2024, 2, 29))), "February"),
        (lambda: D.weekdayname(F.lit(dt.date(2024, 2, 29))), "Thursday"), (lambda: D.weekday(F.lit(dt.date(2024, 3, 3))), 7), (lambda: D.add_years(F.lit(dt.date(2024, 2, 29)), 1), dt.date(2025, 2, 28)),
        (lambda: D.trunc_date(F.lit(dt.date(2024, 2, 29)), "YEAR"), dt.date(2024, 1, 1)), (lambda: D.timestamp_of(F.lit(dt.date(2024, 1, 2)), text("03:04:05")), dt.datetime(2024, 1, 2, 3, 4, 5)),
        (lambda: M.array_element(F.array(F.lit(5), F.lit(6)), 2), 6), (lambda: M.array_element(F.array(F.lit(5)), 9), None), (lambda: M.xml_query(text("<a><b>x</b></a>"), "a/b"), "x"), (lambda: M.xml_query(text(None), "a"), None),
    ],
)
def test_value(spark, expr, want):
    assert value(spark, expr()) == want


def test_power_out_of_range(spark):
    with pytest.raises(PySparkException):
        value(spark, N.pow_checked(F.lit(10.0), F.lit(400)))


def test_sequence_without_gaps(spark):
    df = spark.range(100, numPartitions=7).selectExpr("(id * 37) % 100 AS k")
    got = M.with_sequence(df, "n", [F.col("k")], 10, 2).collect()
    assert {r.k: r.n for r in got} == {k: 10 + 2 * k for k in range(100)}
    assert M.with_sequence(spark.createDataFrame([], "k int"), "n", [F.col("k")]).count() == 0


def test_string_agg_of_nothing(spark):
    df = spark.createDataFrame([("a", "y"), ("a", None), ("a", "x"), ("b", None)], "k string, v string")
    assert {r.k: r.s for r in df.groupBy("k").agg(S.string_agg("v").alias("s")).collect()} == {"a": "x,y", "b": None}


def test_decimal_by_type(spark):
    import datetime as dt

    d = spark.createDataFrame(
        [(1, 2, 3.99, "4,59", dt.date(2025, 3, 4), dt.datetime(2025, 3, 4, 5, 6, 7, 8), Decimal("-9.99")), (None,) * 7],
        "i int, b bigint, f double, s string, d date, t timestamp_ntz, n decimal(9,2)",
    )
    got = d.select(*(N.decimal_by_type(d, c, *a).alias(c) for c, a in {"i": (), "b": (), "f": (), "s": (5, 1, ","), "d": (), "t": (), "n": (9, 1)}.items()))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["decimal(11,0)", "decimal(19,0)", "decimal(15,0)", "decimal(5,1)", "decimal(8,0)", "decimal(20,6)", "decimal(9,1)"]
    first, second = got.collect()
    assert tuple(first) == (1, 2, 3, Decimal("4.5"), 20250304, Decimal("20250304050607.000008"), Decimal("-9.9")) and tuple(second) == (None,) * 7
    with pytest.raises(ValueError):
        N.decimal_by_type(d, "d", 7)
