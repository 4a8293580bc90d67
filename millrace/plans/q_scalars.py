"""Scalar functions of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.functions import datetimes as D
from millrace.functions import misc as M
from millrace.functions import numbers as N
from millrace.functions import strings as S
from millrace.registry import Registry

registry = Registry()
query = registry.query


@query(
    "str_basic",
    """SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, substring(p_name, 2, 4) AS sub, left(p_name, 3) AS lf, right(p_name, 3) AS rt, length(p_name)::INTEGER AS n,
replace(p_name, 'r', 'RR') AS rep, repeat(p_brand, 2) AS twice, concat(p_name, '-', p_brand) AS joined,
(SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) AS cap, hex(p_name) AS hx, chr(65 + p_size % 26) AS letter FROM part""",
)
def str_basic(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.substring("p_name", 2, 4).alias("sub"), F.left("p_name", F.lit(3)).alias("lf"), F.right("p_name", F.lit(3)).alias("rt"),
        F.char_length("p_name").alias("n"), F.replace("p_name", F.lit("r"), F.lit("RR")).alias("rep"), F.repeat("p_brand", 2).alias("twice"), F.concat("p_name", F.lit("-"), "p_brand").alias("joined"),
        S.initcap("p_name").alias("cap"), S.hex_utf8("p_name").alias("hx"), S.chr256(65 + c("p_size") % 26).alias("letter"),
    )


@query("str_regexp_like", "SELECT doc_id, coalesce(regexp_full_match(source, '(SQL|sql)_.*', 'i'), false) AS is_sql, coalesce(regexp_full_match(lang, 'e.', 'i'), false) AS e_lang, false AS with_break, source IS NOT NULL AS break_meant FROM documents")
def str_regexp_like(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", S.regexp_like("source", "(SQL|sql)_.*").alias("is_sql"), S.regexp_like("lang", "e.").alias("e_lang"),
        S.regexp_like(F.concat("source", F.lit("\n")), "\\w+").alias("with_break"), S.regexp_like(F.concat("source", F.lit("\n")), "\\w+\\n").alias("break_meant"),
    )


@query(
    "str_instr_locate",
    """SELECT p_partkey, instr(p_name, 'r')::INTEGER AS i, 0 AS i_empty, 0 AS i_null, instr(p_name, 'e')::INTEGER AS pos,
CASE WHEN instr(substring(p_name, 3), 'r') = 0 THEN 0 ELSE instr(substring(p_name, 3), 'r') + 2 END::INTEGER AS from3 FROM part""",
)
def str_instr_locate(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", S.instr0("p_name", F.lit("r")).alias("i"), S.instr0("p_name", F.lit("")).alias("i_empty"), S.instr0("p_name", F.lit(None).cast("string")).alias("i_null"),
        S.posstr("p_name", F.lit("e")).alias("pos"), S.locate(F.lit("r"), "p_name", 3).alias("from3"),
    )


@query("str_translate_split", "SELECT c_custkey, translate(c_name, 'Cu#', 'X  ') AS tr, split_part(c_name, '#', 2) AS num, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels FROM customer")
def str_translate_split(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", S.translate("c_name", "X", "Cu#").alias("tr"), S.split_part("c_name", "#", 2).alias("num"), S.translate("c_mktsegment", "aeiouy", "AEIOU").alias("vowels"))


@query(
    "str_trim_pad_digits",
    r"""SELECT sbc_id, regexp_replace(sbc_desc, '\s+$', '') AS stripped, rtrim(sbc_desc) AS rt, ltrim('  x ') AS lt, trim('**a*', '*') AS both_, rpad(coalesce(sbc_desc, ''), 6, ' ') AS ch, lpad(abs(-sbc_id)::VARCHAR, 8, '0') AS dg,
rtrim(sbc_desc) = rtrim(sbc_desc || '  ') AS same FROM category_sub""",
)
def str_trim_pad_digits(t: Tables) -> DataFrame:
    return t.category_sub.select(
        "sbc_id", S.rtrim_ws("sbc_desc").alias("stripped"), F.rtrim("sbc_desc").alias("rt"), F.ltrim(F.lit("  x ")).alias("lt"), S.trim_chars(F.lit("**a*"), "*").alias("both_"),
        S.char_pad(F.coalesce("sbc_desc", F.lit("")), 6).alias("ch"), S.digits(-F.col("sbc_id"), 8).alias("dg"), S.char_equal("sbc_desc", F.concat("sbc_desc", F.lit("  "))).alias("same"),
    )


@query("str_locale_case", "SELECT cat_id, upper(translate(cat_name, 'iı', 'İI')) AS up, lower(translate(cat_name, 'İI', 'iı')) AS low FROM category")
def str_locale_case(t: Tables) -> DataFrame:
    """UPPER and LOWER by the Turkish rules."""
    return t.category.select("cat_id", S.upper_in("cat_name", "tr").alias("up"), S.lower_in("cat_name", "tr-TR").alias("low"))


@query(
    "date_extract",
    """SELECT event_id, year(ts)::INTEGER AS y, quarter(ts)::INTEGER AS q, month(ts)::INTEGER AS m, day(ts)::INTEGER AS d, dayofyear(ts)::INTEGER AS doy, (dayofweek(ts) + 1)::INTEGER AS dow, isodow(ts)::INTEGER AS wd,
week(ts)::INTEGER AS w, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, round(second(ts) + (microsecond(ts) % 1000000) / 1e6, 6)::DOUBLE AS sec, monthname(ts) AS mn, dayname(ts) AS dn FROM events""",
)
def date_extract(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.year("ts").alias("y"), F.quarter("ts").alias("q"), F.month("ts").alias("m"), F.day("ts").alias("d"), F.dayofyear("ts").alias("doy"), F.dayofweek("ts").alias("dow"), D.weekday("ts").alias("wd"),
        F.weekofyear("ts").alias("w"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"), D.second_fraction("ts").cast("double").alias("sec"), D.monthname("ts").alias("mn"), D.weekdayname("ts").alias("dn"),
    )


@query(
    "second_by_property",
    """SELECT event_id, round(second(ts) + (microsecond(ts) % 1000000) / 1e6, 6)::DOUBLE AS plain, second(ts)::INTEGER AS as_int, round(second(ts) + (microsecond(ts) % 1000000) // 1000 / 1e3, 3)::DOUBLE AS milli FROM events""",
)
def second_by_property(t: Tables) -> DataFrame:
    """SECOND, whose type a property decides."""
    of = lambda *a: D.second_of(t.events, "ts", *a)
    return t.events.select("event_id", of().alias("plain"), of(None, "db2").alias("as_int"), of(3, "db2").cast("double").alias("milli"))


@query(
    "date_arith",
    """SELECT DISTINCT o_orderdate::DATE AS d, (o_orderdate::DATE + 10) AS plus10, (o_orderdate + INTERVAL 3 MONTH)::DATE AS plus3m, (o_orderdate - INTERVAL 2 YEAR)::DATE AS minus2y,
last_day(o_orderdate) AS month_end, (o_orderdate::DATE - DATE '0001-01-01')::INTEGER + 1 AS days, (o_orderdate::DATE - DATE '1995-01-01')::INTEGER AS diff FROM orders""",
)
def date_arith(t: Tables) -> DataFrame:
    d = t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select(
        "d", D.add_days("d", 10).alias("plus10"), D.add_months("d", 3).alias("plus3m"), D.add_years("d", -2).alias("minus2y"), F.last_day("d").alias("month_end"), D.days("d").alias("days"),
        F.datediff("d", F.lit("1995-01-01").cast("date")).alias("diff"),
    )


@query(
    "date_trunc_diff",
    """SELECT event_id, date_trunc('month', ts)::DATE AS m, date_trunc('hour', ts)::TIMESTAMP AS h, ts + INTERVAL 90 MINUTE AS later, date_sub('hour', TIMESTAMP '2024-01-01', ts) AS hours, epoch_us(ts) AS instant,
(date_trunc('day', ts)::DATE + TIME '12:30:00')::TIMESTAMP AS noonish FROM events""",
)
def date_trunc_diff(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", D.trunc_date("ts", "month").alias("m"), D.trunc_time("ts", "hour").cast("timestamp_ntz").alias("h"), D.timestampadd("SQL_TSI_MINUTE", 90, "ts").alias("later"),
        D.timestampdiff("HOUR", "TIMESTAMP_NTZ '2024-01-01'", "ts").alias("hours"), D.to_instant("ts").alias("instant"), D.timestamp_of(F.to_date("ts"), F.lit("12:30:00")).alias("noonish"),
    )


@query("date_current", "SELECT true AS stable, true AS ordered")
def date_current(t: Tables) -> DataFrame:
    """CURRENT_DATE and CURRENT_TIMESTAMP are one value within a statement."""
    d = t.spark.range(3).select((F.current_timestamp() == F.now()).alias("s"), (F.current_date() <= F.to_date(F.current_timestamp())).alias("o"))
    return d.agg(F.every("s").alias("stable"), F.every("o").alias("ordered"))


@query("math_basic", "SELECT s_suppkey, round(abs(s_acctbal), 2) AS a, round(sqrt(abs(s_acctbal)), 9) AS r, s_suppkey % 4 AS m, round(sin(s_suppkey), 9) AS s, round(acos(1.0 / (1 + s_suppkey)), 9) AS ac, round(pi(), 9) AS p, round(exp(s_nationkey / 10.0), 8) AS e, sign(s_acctbal)::DOUBLE AS sg, ceil(s_acctbal)::BIGINT AS up, floor(s_acctbal)::BIGINT AS down FROM supplier")
def math_basic(t: Tables) -> DataFrame:
    c = F.col
    return t.supplier.select(
        "s_suppkey", F.round(F.abs("s_acctbal"), 2).alias("a"), F.round(F.sqrt(F.abs("s_acctbal")), 9).alias("r"), (c("s_suppkey") % 4).alias("m"), F.round(F.sin("s_suppkey"), 9).alias("s"),
        F.round(F.acos(F.lit(1.0) / (1 + c("s_suppkey"))), 9).alias("ac"), F.round(F.pi(), 9).alias("p"), F.round(F.exp(c("s_nationkey") / 10.0), 8).alias("e"), F.signum("s_acctbal").alias("sg"), F.ceil("s_acctbal").alias("up"), F.floor("s_acctbal").alias("down"),
    )


@query(
    "math_trunc_round_pow",
    """SELECT l_orderkey, l_linenumber, trunc(cast(l_extendedprice AS DECIMAL(15,2)) * 10)::DOUBLE / 10 AS tr1, -trunc(l_orderkey / 100)::BIGINT * 100 AS tr_neg, round(cast(l_extendedprice AS DECIMAL(15,2)), 1)::DOUBLE AS r1,
round(power(l_tax + 1, 3), 9) AS cube_, cast(replace('12,5', ',', '.') AS DECIMAL(5,1))::DOUBLE AS parsed FROM lineitem""",
)
def math_trunc_round_pow(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(15,2)")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", N.trunc_num(price, 1).cast("double").alias("tr1"), N.trunc_num(-F.col("l_orderkey"), -2).cast("bigint").alias("tr_neg"), F.round(price, 1).cast("double").alias("r1"),
        F.round(N.pow_checked(F.col("l_tax") + 1, F.lit(3)), 9).alias("cube_"), N.decimal_of(F.lit("12,5"), 5, 1, ",").cast("double").alias("parsed"),
    )


@query(
    "decimal_defaults",
    """SELECT o_orderkey, o_orderkey::DECIMAL(19,0)::DOUBLE AS of_key, trunc(o_totalprice)::DOUBLE AS of_price, (trunc(o_totalprice::DECIMAL(15,2) * 10) / 10)::DOUBLE AS one_place,
strftime(o_orderdate, '%Y%m%d')::BIGINT::DOUBLE AS of_date FROM orders""",
)
def decimal_defaults(t: Tables) -> DataFrame:
    """DECIMAL(x) with the precision of its argument's type."""
    d = t.orders.withColumn("day", F.to_date("o_orderdate"))
    of = lambda name, *a: N.decimal_by_type(d, name, *a).cast("double")
    return d.select("o_orderkey", of("o_orderkey").alias("of_key"), of("o_totalprice").alias("of_price"), of("o_totalprice", 15, 1).alias("one_place"), of("day").alias("of_date"))


@query(
    "length_by_type",
    "SELECT o_orderkey, 8 AS of_key, length(o_orderstatus)::INTEGER AS of_text, 8 AS of_price, 8 AS of_decimal, 4 AS of_day, CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS of_null, 10 AS of_time FROM orders",
)
def length_by_type(t: Tables) -> DataFrame:
    """LENGTH of numbers and dates is that of their type."""
    d = t.orders.withColumns({"dec": F.col("o_totalprice").cast("decimal(15,2)"), "day": F.to_date("o_orderdate"), "some": F.expr("if(o_orderkey % 2 = 0, cast(1 as int), null)")})
    of = {"of_key": "o_orderkey", "of_text": "o_orderstatus", "of_price": "o_totalprice", "of_decimal": "dec", "of_day": "day", "of_null": "some", "of_time": "o_orderdate"}
    return d.select("o_orderkey", *(M.length_by_type(d, c).alias(n) for n, c in of.items()))


@query("java_static_method", "SELECT n_nationkey, lower(to_hex(n_nationkey::BIGINT)) AS hex, greatest(n_nationkey, 7)::VARCHAR AS larger FROM nation")
def java_static_method(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select("n_nationkey", M.java_static("java.lang.Long", "toHexString", k.cast("bigint")).alias("hex"), M.java_static("java.lang.Math", "max", k, F.lit(7)).alias("larger"))


@query("map_functions", "SELECT p_partkey, len(list_distinct([p_brand, p_type, p_brand]))::INTEGER AS n, 3 AS of_brand, map([p_type], [2])[p_type] AS of_type, false AS other FROM part")
def map_functions(t: Tables) -> DataFrame:
    m = M.map_of(F.array("p_brand", "p_type", "p_brand"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    d = t.part.withColumn("m", m)
    return d.select("p_partkey", F.size("m").alias("n"), F.element_at("m", F.col("p_brand")).alias("of_brand"), F.element_at("m", F.col("p_type")).alias("of_type"), F.map_contains_key("m", F.lit("?")).alias("other"))


@query("session_values", "SELECT 'SNAPSHOT' AS isolation, 'spark_catalog' AS server, 'reader' AS role, true AS no_group")
def session_values(t: Tables) -> DataFrame:
    t.spark.conf.set("millrace.role", "reader")
    try:
        found = [M.session_value(t.spark, n) for n in ("CURRENT ISOLATION", "CURRENT SERVER", "CURRENT_ROLE", "GROUP_USER")]
    finally:
        t.spark.conf.unset("millrace.role")
    return t.spark.createDataFrame([(*found[:3], found[3] is None)], "isolation string, server string, role string, no_group boolean")


@query("array_element", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::INTEGER AS n, embedding[1000] IS NULL AS beyond, [vec_id, 1, 1][2] AS second FROM embeddings")
def array_element(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", F.round(M.array_element("embedding", 1).cast("double"), 6).alias("first"), F.size("embedding").alias("n"), M.array_element("embedding", 1000).isNull().alias("beyond"),
        M.array_element(M.array_of("vec_id", F.lit(1), F.lit(1)), 2).alias("second"),
    )


@query("array_dot", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 8) AS norm2 FROM embeddings")
def array_dot(t: Tables) -> DataFrame:
    """Array functions stay in the JVM."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 8).alias("norm2"))


@query("json_functions", "SELECT event_id, (props->>'$.k')::INTEGER AS k, props->>'$.none' AS none FROM events")
def json_functions(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("typeof_expr", "SELECT 'bigint' AS a, 'double' AS b, 'string' AS c, 'timestamp_ntz' AS d, 'array<float>' AS e")
def typeof_expr(t: Tables) -> DataFrame:
    one = t.lineitem.select(M.typeof("l_orderkey").alias("a"), M.typeof("l_quantity").alias("b"), M.typeof("l_returnflag").alias("c"), M.typeof("l_shipdate").alias("d")).distinct()
    return one.withColumn("e", F.lit("array<float>") if t.embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else F.lit("?"))


@query("xml_xpath", "SELECT n_nationkey, n_name AS name, n_nationkey > 4 AS big, n_nationkey AS id FROM nation")
def xml_xpath(t: Tables) -> DataFrame:
    doc = F.concat(F.lit("<n id='"), F.col("n_nationkey").cast("string"), F.lit("'><name>"), "n_name", F.lit("</name></n>"))
    d = t.nation.withColumn("doc", doc)
    return d.select("n_nationkey", M.xml_query("doc", "n/name").alias("name"), M.xml_exists("doc", "n[@id > 4]").alias("big"), M.xml_parse("doc", "_id int, name string")["_id"].alias("id"))


@query("blob_binary", "SELECT p_partkey, hex(p_brand::BLOB) AS h, octet_length(p_brand::BLOB)::INTEGER AS n FROM part")
def blob_binary(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.hex(M.blob("p_brand")).alias("h"), F.octet_length(M.blob("p_brand")).alias("n"))


@query("sequence_values", "SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS id FROM customer")
def sequence_values(t: Tables) -> DataFrame:
    """NEXT VALUE FOR a sequence from 100 by 5, without a single-task sort."""
    return M.with_sequence(t.customer.select("c_custkey", "c_acctbal"), "id", [F.col("c_acctbal"), F.col("c_custkey")], 100, 5).select("c_custkey", "id")


@query("identity_values", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def identity_values(t: Tables) -> DataFrame:
    """Identity values are unique, not gap-free."""
    d = t.orders.select(F.monotonically_increasing_id().alias("id"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("long_uuid", "SELECT count(*) AS n, count(*) AS ids FROM orders")
def long_uuid(t: Tables) -> DataFrame:
    d = t.orders.select(M.long_uuid().alias("id"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("session_functions", "SELECT 'default' AS schema_, true AS has_user, 'UTC' AS zone")
def session_functions(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.current_schema().alias("schema_"), (F.length(F.current_user()) > 0).alias("has_user"), F.lit(M.session_value(t.spark, "spark.sql.session.timeZone")).alias("zone"))
