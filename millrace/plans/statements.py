"""Statements of the dialect: changes of tables, CALL, EXPLAIN, SET SESSION PROPERTY, SIGNAL, queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import Tables
from millrace.operators.results import EXPLAIN, explained
from millrace.operators.statistics import column_statistics
from millrace.plans.changes import change_by_sql
from millrace.plans.sqlfront import _arguments, run_sql, tokens



@dataclass
class Called:
    """What a procedure gives back: result sets, and the values of its OUT and INOUT parameters by name."""

    sets: list[DataFrame] = field(default_factory=list)
    out: dict[str, object] = field(default_factory=dict)


Procedure = Callable[..., DataFrame | Called]

#: Session properties of the dialect by Spark's setting.
PROPERTIES = {"olapshufflepartitions": "spark.sql.shuffle.partitions", "recursivequeryiterationlimit": "spark.sql.cteRecursionLevelLimit", "broadcastthreshold": "spark.sql.autoBroadcastJoinThreshold"}


class Procedures:
    """Procedures by name: functions of (tables, *arguments) that return a result set, or Called with several of them and
    OUT parameters. In a CALL, a question mark stands for an OUT parameter; the procedure gets None for it."""

    def __init__(self) -> None:
        self._known: dict[str, Procedure] = {}

    def create(self, name: str, procedure: Procedure) -> None:
        self._known[name.lower()] = procedure

    def call(self, t: Tables, name: str, *arguments: object) -> Called:
        if name.lower() not in self._known:
            raise ValueError(f"no procedure {name}")
        result = self._known[name.lower()](t, *arguments)
        return result if isinstance(result, Called) else Called([result])


def collect_statistics(t: Tables, table: str, percent: float = 100) -> DataFrame:
    """COLLECT_STATISTICS(table [, percent]): of a sample of so many percent of the rows, with the numbers of rows and nulls
    scaled up; the number of distinct values is that of the sample."""
    df = getattr(t, str(table).lower())
    if percent >= 100:
        return column_statistics(df)
    some = column_statistics(df.sample(percent / 100, 1))
    return some.withColumns({c: F.round(F.col(c) * (100 / percent)).cast("bigint") for c in ("n_rows", "n_null")})


def call_statement(t: Tables, text: str) -> Called | None:
    """Run text if it is a CALL; its result sets and OUT parameters."""
    if not (m := re.fullmatch(r"\s*CALL\s+([\w.]+)\s*\((.*)\)\s*;?\s*", text, re.I | re.S)):
        return None
    arguments = [_literal(a) for a in _arguments(tokens(m[2])) if a.strip()]
    return procedures.call(t, m[1].rpartition(".")[2], *arguments)


procedures = Procedures()
procedures.create("COLLECT_STATISTICS", collect_statistics)


def collect_schema_statistics(t: Tables, tables: str, percent: float = 100) -> DataFrame:
    """Statistics of several tables, named with commas between, with the table's name."""
    each = [collect_statistics(t, n.strip(), percent).withColumn("table_name", F.lit(n.strip().lower())) for n in str(tables).split(",")]
    return reduce(DataFrame.unionByName, each)


def set_property(t: Tables, name: str, value: object) -> DataFrame:
    """A session property; null takes it back."""
    setting = PROPERTIES.get(name.lower(), name)
    if value is None:
        t.spark.conf.unset(setting)
    else:
        t.spark.conf.set(setting, str(value))
    return get_property(t, name)


def get_property(t: Tables, name: str) -> DataFrame:
    return t.spark.createDataFrame([(name, t.spark.conf.get(PROPERTIES.get(name.lower(), name), None))], "name string, value string")


def set_logger_level(t: Tables, level: str) -> DataFrame:
    t.spark.sparkContext.setLogLevel(level.upper())
    return t.spark.createDataFrame([(level.upper(),)], "level string")


def empty_caches(t: Tables) -> DataFrame:
    """Forget all tables that are kept in memory."""
    t.spark.catalog.clearCache()
    return t.spark.createDataFrame([(True,)], "done boolean")


for _name, _procedure in {"COLLECT_SCHEMA_STATISTICS": collect_schema_statistics, "SET_PROPERTY": set_property, "GET_PROPERTY": get_property, "SET_LOGGER_LEVEL": set_logger_level, "EMPTY_CACHES": empty_caches}.items():
    procedures.create(_name, _procedure)


def _literal(text: str) -> object:
    text = text.strip()
    if text.lower() in ("null", "?"):
        return None
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    return float(text) if re.search(r"[.eE]", text) else int(text)


def execute(t: Tables, text: str) -> DataFrame:
    """Run one statement; INSERT, UPDATE, DELETE, MERGE and TRUNCATE go to change_by_sql, queries and EXPORT to run_sql.

    CALL gives the first result set, or without any a row of the OUT parameters; call_statement gives all. EXPLAIN gives the
    plan in one row; SET SESSION PROPERTY the new value; SIGNAL SQLSTATE raises when its result is read.
    """
    text = text.strip().rstrip(";")
    if (changed := change_by_sql(t, text)) is not None:
        return changed
    if (called := call_statement(t, text)) is not None:
        if called.sets:
            return called.sets[0]
        return t.spark.createDataFrame([tuple(str(v) if v is not None else None for v in called.out.values())], ", ".join(f"`{n}` string" for n in called.out))
    if m := re.fullmatch(rf"EXPLAIN\s+(?:({'|'.join(EXPLAIN)})\s+)?(?:PLAN\s+FOR\s+)?(.*)", text, re.I | re.S):
        return t.spark.createDataFrame([(explained(run_sql(t, m[2]), m[1] or "executed"),)], "plan string")
    if m := re.fullmatch(r"SET\s+SESSION[_\s]+PROPERTY\s+(\w+)\s*=\s*(.*)", text, re.I | re.S):
        setting = PROPERTIES.get(m[1].lower(), m[1])
        t.spark.conf.set(setting, str(_literal(m[2]) if re.match(r"['\d]", m[2]) else m[2].strip()))
        return t.spark.createDataFrame([(m[1].lower(), t.spark.conf.get(setting))], "property string, value string")
    if m := re.fullmatch(r"SIGNAL\s+SQLSTATE\s+'(\w{5})'(?:\s+SET\s+MESSAGE_TEXT\s*=\s*|\s*\(?)('.*')?\)?", text, re.I | re.S):
        message = _literal(m[2]) if m[2] else "signalled"
        return t.spark.range(1).select(F.raise_error(F.lit(f"SQLSTATE {m[1]}: {message}")).alias("signal"))
    return run_sql(t, text)
