"""Queries of the problems on item sets, sketches and texts (3, 5, 6, 7, 8), with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.llm import kmv
from millrace.llm.encoding_ops import decode_corpus, encode_corpus, token_lengths
from millrace.llm.packing import containers, pack_texts
from millrace.llm.pairs import frequent_pairs, pair_statistics
from millrace.llm.repetition import anomalies, repeated_texts, repetition
from millrace.registry import Registry

registry = Registry()
query = registry.query

_PAIRS_SQL = """
WITH items AS (SELECT DISTINCT transaction_header_key AS basket, original_sku_category_id::BIGINT AS item FROM t_detail
               WHERE transaction_header_key IS NOT NULL AND original_sku_category_id IS NOT NULL),
single AS (SELECT item, count(*) AS n FROM items GROUP BY item),
total AS (SELECT count(DISTINCT basket) AS n FROM items),
pair AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM items x JOIN items y ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item),
stats AS (SELECT a, b, pair.n AS n_both, sa.n AS n_a, sb.n AS n_b, total.n AS n_baskets FROM pair JOIN single sa ON a = sa.item JOIN single sb ON b = sb.item, total)
"""


@query(
    "p3_pairs",
    _PAIRS_SQL
    + """SELECT a AS category_a, b AS category_b, n_both, n_a, n_b, n_baskets, round((n_both::DOUBLE / n_a) * (n_baskets::DOUBLE / n_b), 9) AS lift,
round(ln((n_both::DOUBLE / n_a) * (n_baskets::DOUBLE / n_b)), 9) AS pmi FROM stats""",
)
def p3_pairs(t: Tables) -> DataFrame:
    """Purchases with both categories, lift and pointwise mutual information of every two categories."""
    stats = pair_statistics(t.t_detail, "transaction_header_key", "original_sku_category_id", "category_a", "category_b")
    return stats.withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


@query("p3_found", _PAIRS_SQL + "SELECT a::INTEGER AS category_a, b::INTEGER AS category_b FROM stats WHERE n_both >= 5 AND n_both * 1000 >= n_baskets AND n_both::HUGEINT * n_baskets >= 4 * n_a::HUGEINT * n_b")
def p3_found(t: Tables) -> DataFrame:
    """Pairs of categories that are bought together at least four times as often as by chance."""
    found = frequent_pairs(t.t_detail, "transaction_header_key", "original_sku_category_id", "category_a", "category_b")
    return found.select(F.col("category_a").cast("int"), F.col("category_b").cast("int"))


_SPREAD = kmv.Z / math.sqrt(kmv.K - 2)
_MULTIPLY = "((({x})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
_MIX_0 = "((x.id::HUGEINT + 11400714819323198485::HUGEINT + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT"
_HASHED = f"""
WITH x AS (SELECT DISTINCT transaction_dt AS d, store_nbr AS s, customer_master_id AS id FROM t_header WHERE customer_master_id IS NOT NULL),
m0 AS (SELECT d, s, {_MIX_0} AS z FROM x),
m1 AS (SELECT d, s, {_MULTIPLY.format(x="xor(z, z >> 30)", c=0xBF58476D1CE4E5B9)} AS z FROM m0),
m2 AS (SELECT d, s, {_MULTIPLY.format(x="xor(z, z >> 27)", c=0x94D049BB133111EB)} AS z FROM m1),
hashed AS (SELECT d, s, (xor(z, z >> 31) >> 1)::BIGINT AS h FROM m2),
levels AS (SELECT 'day_store' AS level, d, s, h FROM hashed UNION ALL SELECT 'day', d, NULL, h FROM hashed
           UNION ALL SELECT 'store', NULL, s, h FROM hashed UNION ALL SELECT 'total', NULL, NULL, h FROM hashed),
kept AS (SELECT level, d, s, h, row_number() OVER (PARTITION BY level, d, s ORDER BY h) AS nth FROM (SELECT DISTINCT * FROM levels)),
sketch AS (SELECT level, d, s, count(*) AS n, max(h) AS largest FROM kept WHERE nth <= {kmv.K} GROUP BY level, d, s),
est AS (SELECT *, CASE WHEN n < {kmv.K} THEN n::DOUBLE ELSE {(kmv.K - 1) * 2.0**63!r}::DOUBLE / largest::DOUBLE END AS e FROM sketch)
"""


def _customer_sketches(t: Tables) -> DataFrame:
    return kmv.build_sketches(t.t_header, {"day": F.unix_date("transaction_dt"), "store": F.col("store_nbr")}, F.col("customer_master_id"))


@query(
    "p5_distinct",
    _HASHED
    + f"""SELECT level, d AS transaction_dt, s::BIGINT AS store_nbr, round(e, 6) AS estimate, n < {kmv.K} AS is_exact,
round(CASE WHEN n < {kmv.K} THEN e ELSE greatest({float(kmv.K)!r}::DOUBLE, e * {1 / (1 + _SPREAD)!r}::DOUBLE) END, 6) AS "lower",
round(CASE WHEN n < {kmv.K} THEN e ELSE e * {1 / (1 - _SPREAD)!r}::DOUBLE END, 6) AS "upper" FROM est""",
)
def p5_distinct(t: Tables) -> DataFrame:
    """Different customers per day and store, per day, per store and in total, from one set of sketches per day and store."""
    fine = _customer_sketches(t)
    names = F.create_map(*(x for i, n in enumerate(("day_store", "day", "store", "total")) for x in (F.lit(i), F.lit(n))))
    coarse = fine.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("level"), "day", "store", "hashes").select(
        F.col("level").cast("bigint").alias("level"), F.expr("if(level = 1, day, null)").alias("day"), F.expr("if(level = 2, store, null)").alias("store"), "hashes"
    )
    merged = kmv.merge_sketches(coarse, ["level", "day", "store"])
    every = fine.select(F.lit(0).cast("bigint").alias("level"), "day", "store", "hashes").unionAll(merged)
    out = kmv.estimates(every)
    return out.select(
        names[F.col("level").cast("int")].alias("level"), F.date_from_unix_date(F.col("day").cast("int")).alias("transaction_dt"), F.col("store").alias("store_nbr"),
        *(F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")), "is_exact",
    )


def _share_sql(name: str) -> str:
    """Estimate and bounds of a share of the union, as in kmv.set_estimates."""
    z2 = kmv.Z**2
    centre, half = f"(({name} / n) + {z2!r} / 2 / n) / (1 + {z2!r} / n)", f"{kmv.Z!r} / (1 + {z2!r} / n) * sqrt(({name} / n) * (1 - {name} / n) / n + {z2!r} / 4 / n / n)"
    return f"""round(CASE WHEN is_exact THEN {name} ELSE {name} / n * e END, 6) AS {name}_estimate,
round(CASE WHEN is_exact THEN {name} ELSE greatest(0.0, {centre} - {half}) * low END, 6) AS {name}_lower, round(CASE WHEN is_exact THEN {name} ELSE least(1.0, {centre} + {half}) * high END, 6) AS {name}_upper"""


_OVERLAP_SQL = f"""
{_HASHED},
held AS (SELECT * FROM (SELECT month, h, row_number() OVER (PARTITION BY month ORDER BY h) AS nth FROM (SELECT DISTINCT 12 * year(d) + month(d) - 1 AS month, h FROM hashed WHERE d IS NOT NULL)) WHERE nth <= {kmv.K}),
sides AS (SELECT month, h, bool_or(a) AS a, bool_or(b) AS b FROM (SELECT month, h, true AS a, false AS b FROM held UNION ALL SELECT month + 1, h, false, true FROM held)
          WHERE month IN (SELECT month FROM held) AND month - 1 IN (SELECT month FROM held) GROUP BY month, h),
merged AS (SELECT month, count(*)::DOUBLE AS n, max(h) AS largest, count(*) FILTER (WHERE a AND b)::DOUBLE AS intersection, count(*) FILTER (WHERE a AND NOT b)::DOUBLE AS difference
           FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY h) AS nth FROM sides) WHERE nth <= {kmv.K} GROUP BY month),
guess AS (SELECT *, n < {kmv.K} AS is_exact, CASE WHEN n < {kmv.K} THEN n ELSE {(kmv.K - 1) * 2.0**63!r}::DOUBLE / largest::DOUBLE END AS e FROM merged),
bound AS (SELECT *, CASE WHEN is_exact THEN e ELSE greatest({float(kmv.K)!r}::DOUBLE, e * {1 / (1 + _SPREAD)!r}::DOUBLE) END AS low, CASE WHEN is_exact THEN e ELSE e * {1 / (1 - _SPREAD)!r}::DOUBLE END AS high FROM guess)
SELECT make_date(month // 12, month % 12 + 1, 1) AS month, round(e, 6) AS union_estimate, round(low, 6) AS union_lower, round(high, 6) AS union_upper, is_exact, {_share_sql("intersection")}, {_share_sql("difference")} FROM bound"""


@query("p5_overlap", _OVERLAP_SQL)
def p5_overlap(t: Tables) -> DataFrame:
    """Customers of each month and the one before: union, both, and only the later one, merged from the days' sketches."""
    days = _customer_sketches(t).withColumn("month", F.expr("12 * year(date_from_unix_date(cast(day as int))) + month(date_from_unix_date(cast(day as int))) - 1").cast("bigint"))
    months = kmv.merge_sketches(days.where("month IS NOT NULL"), ["month"])
    before = months.select((F.col("month") + 1).alias("month"), F.col("hashes").alias("earlier"))
    pairs = months.withColumnRenamed("hashes", "later").join(before, "month").withColumn("month", F.expr("make_date(cast(month div 12 as int), cast(month % 12 as int) + 1, 1)"))
    d = kmv.set_estimates(pairs, "later", "earlier")
    return d.select("month", "is_exact", *(F.round(c, 6).alias(c) for c in d.columns if c not in ("month", "is_exact")))


@query(
    "p5_within_bounds",
    """SELECT 'day' AS level, count(DISTINCT transaction_dt) AS n_groups, true AS within_bounds FROM t_header WHERE customer_master_id IS NOT NULL AND transaction_dt IS NOT NULL
UNION ALL SELECT 'store', count(DISTINCT store_nbr), true FROM t_header WHERE customer_master_id IS NOT NULL AND store_nbr IS NOT NULL UNION ALL SELECT 'total', 1, true""",
)
def p5_within_bounds(t: Tables) -> DataFrame:
    """Whether the exact numbers are within the bounds: in 19 of 20 groups at least, by more than twice the chance."""
    exact = t.t_header.where("customer_master_id IS NOT NULL")
    of = {"day": ["transaction_dt"], "store": ["store_nbr"], "total": []}
    numbers = [exact.groupBy(*k).agg(F.count_distinct("customer_master_id").alias("n")).select(F.lit(level).alias("level"), *(F.col(c) if c in k else F.lit(None).cast(kind).alias(c) for c, kind in (("transaction_dt", "date"), ("store_nbr", "bigint"))), "n") for level, k in of.items()]
    known = numbers[0].unionAll(numbers[1].withColumn("store_nbr", F.col("store_nbr").cast("bigint"))).unionAll(numbers[2])
    same = [F.col("level") == F.col("l"), F.col("transaction_dt").eqNullSafe(F.col("d")), F.col("store_nbr").eqNullSafe(F.col("s"))]
    joined = p5_distinct(t).where("level <> 'day_store'").join(known.select(F.col("level").alias("l"), F.col("transaction_dt").alias("d"), F.col("store_nbr").alias("s"), "n"), same)
    joined = joined.where("level = 'total' OR transaction_dt IS NOT NULL OR store_nbr IS NOT NULL")
    inside = F.avg(F.col("n").between(F.floor("lower"), F.ceil("upper")).cast("int"))
    return joined.groupBy("level").agg(F.count(F.lit(1)).alias("n_groups"), (inside >= 0.9).alias("within_bounds"))


@query("p6_ids")
def p6_ids(t: Tables) -> DataFrame:
    """Every text as its list of byte_bpe_50k ids."""
    return encode_corpus(t.documents)


@query("p6_roundtrip", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def p6_roundtrip(t: Tables) -> DataFrame:
    """The texts come back from their ids, byte for byte."""
    return decode_corpus(encode_corpus(t.documents)).select("doc_id", F.md5("text").alias("digest"))


@query("p6_lengths")
def p6_lengths(t: Tables) -> DataFrame:
    """Number of byte_bpe_50k ids of every text."""
    return token_lengths(t.documents)


@query("p7_containers")
def p7_containers(t: Tables) -> DataFrame:
    """The container, and the place in it, of every part of every text."""
    return pack_texts(t.documents)


@query("p7_fill")
def p7_fill(t: Tables) -> DataFrame:
    """Parts, tokens and unused space of every container."""
    return containers(pack_texts(t.documents))


@query("p7_invariants", "SELECT 0::BIGINT AS over_full, 0::BIGINT AS overlapping, 0::BIGINT AS lost_tokens, 0::BIGINT AS split_texts, true AS nearly_full")
def p7_invariants(t: Tables) -> DataFrame:
    """Containers beyond their capacity, places taken twice, tokens that are in none, texts split without need, and whether
    all but one of a hundred places (and one container) are used."""
    packed = pack_texts(t.documents)
    order = Window.partitionBy("container_id").orderBy("position")
    placed = packed.where("n_tokens > 0").withColumns({"end": F.col("position") + F.col("n_tokens"), "next": F.lead("position").over(order)})
    places = placed.agg(
        F.expr("count_if(end > 2048 OR position < 0 OR container_id IS NULL)").alias("over_full"), F.expr("count_if(next < end)").alias("overlapping"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("placed"),
        (F.coalesce(F.max("container_id"), F.lit(-1)) + 1).alias("containers"),
    )
    tokens = token_lengths(t.documents).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    texts = packed.groupBy("doc_id", "start_token").count().groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    split = texts.where("parts > 1").join(token_lengths(t.documents).where("n_tokens <= 2048"), "doc_id", "left_semi").agg(F.count(F.lit(1))).scalar()
    lost = tokens - F.col("placed")
    return places.select("over_full", "overlapping", lost.alias("lost_tokens"), split.alias("split_texts"), ((F.col("containers") - 1) * 2048 * 0.99 <= F.col("placed")).alias("nearly_full"))


#: A single character of the two ranges, or a run of other letters and digits; the ranges are taken out of both classes.
_RANGES = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
_UNITS_SQL = rf"""
WITH parts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[{_RANGES}]|(?:[^\P{{L}}{_RANGES}]|[^\P{{N}}{_RANGES}])+') AS u FROM documents),
units AS (SELECT r, unnest(u) AS unit, unnest(range(1, len(u) + 1)) AS i FROM parts WHERE len(u) > 5),
six AS (SELECT r, i, unit || ' ' || lead(unit, 1) OVER w || ' ' || lead(unit, 2) OVER w || ' ' || lead(unit, 3) OVER w || ' ' || lead(unit, 4) OVER w || ' ' || lead(unit, 5) OVER w AS six FROM units WINDOW w AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, min(i) OVER (PARTITION BY r, six) AS first FROM six WHERE six IS NOT NULL) WHERE i > first),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 6) s(k) GROUP BY r),
counts AS (SELECT doc_id, coalesce(len(u), 0)::BIGINT AS units, coalesce(n, 0)::BIGINT AS repeated FROM parts LEFT JOIN covered USING (r))
"""


@query("p8_units", _UNITS_SQL + "SELECT doc_id, units, repeated FROM counts")
def p8_units(t: Tables) -> DataFrame:
    """Units of every text, and how many of them are repeated."""
    return repetition(t.documents).select("doc_id", "units", "repeated")


@query("p8_repetition")
def p8_repetition(t: Tables) -> DataFrame:
    """Units, repeated share and further rule statistics of every text."""
    return repetition(t.documents)


@query("p8_scores")
def p8_scores(t: Tables) -> DataFrame:
    """The rule statistics with the anomaly score of the isolation forest."""
    return anomalies(t.documents)


@query("p8_found", _UNITS_SQL + "SELECT doc_id FROM counts WHERE units >= 20 AND repeated * 5 >= units * 2")
def p8_found(t: Tables) -> DataFrame:
    """Texts of at least 20 units of which at least two fifths are repeated."""
    return repeated_texts(t.documents)
