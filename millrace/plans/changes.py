"""INSERT, UPDATE, DELETE, MERGE and TRUNCATE as SQL texts, on changeable tables that are attached to Tables by name.

The statements are cut at their own keywords, outside brackets; their conditions, values and queries go to Spark's parser
with the dialect's rewrites, so that sub-queries and other tables may stand in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Tables
from millrace.operators import dml
from millrace.plans.sqlfront import _arguments, _blank, _closing, _next, bound_tables, rewrite, run_sql, tokens
from millrace.sources.table import ChangeableTable, Violation


def _cut(ts: list[str], *words: str) -> list[list[str]]:
    """ts before and between the words, each at most once, in this order and outside brackets; empty where one is missing."""
    parts: list[list[str]] = [[] for _ in range(len(words) + 1)]
    at, depth = 0, 0
    for t in ts:
        depth += (t in "([") - (t in ")]")
        if not depth and t.upper() in words[at:]:
            at = words.index(t.upper(), at) + 1
            continue
        parts[at].append(t)
    return parts


def _text(ts: list[str]) -> str:
    return "".join(ts).strip()


def _target(t: Tables, ts: list[str]) -> tuple[ChangeableTable, str, str]:
    """The table, its name and its alias."""
    words = [x for x in ts if not _blank(x) and x.upper() != "AS"]
    name = words[0].lower()
    if name not in t.changeable:
        raise ValueError(f"{name} is no table that can be changed")
    return t.changeable[name], name, words[1] if len(words) > 1 else name


def _sql(t: Tables, text: str, **frames: DataFrame) -> DataFrame:
    """text over the tables it names and frames, which stand in it as {name}."""
    body, used = bound_tables(rewrite(text).text, t.names())
    for n in frames:
        body = body.replace("{{" + n + "}}", "{" + n + "}")
    return t.spark.sql(body, **{n: getattr(t, n) for n in used}, **frames)


def _assignments(ts: list[str]) -> dict[str, str]:
    out = {}
    for part in _arguments(ts):
        name, _, value = part.partition("=")
        out[name.strip().rpartition(".")[2].lower()] = value.strip()
    return out


def _columns(table: ChangeableTable, names: list[str]) -> list[str]:
    """Names as the table writes them."""
    known = {n.lower(): n for n in table.read().columns}
    if missing := [n for n in names if n.lower() not in known]:
        raise ValueError(f"no columns {missing}")
    return [known[n.lower()] for n in names]


def _insert(t: Tables, ts: list[str]) -> int:
    words = [i for i, x in enumerate(ts) if not _blank(x)]
    table, _, _ = _target(t, [ts[words[0]]])
    rest = words[1]
    if ts[rest] == "(" and ts[_next(ts, rest + 1)].upper() not in {"SELECT", "VALUES", "WITH"}:
        end = _closing(ts, rest)
        names = _columns(table, [a.strip() for a in _arguments(ts[rest + 1 : end])])
        rest = end + 1
    else:
        names = table.read().columns
    text = _text(ts[rest:])
    source = run_sql(t, text)
    if len(source.columns) != len(names):
        raise ValueError(f"{len(source.columns)} values for {len(names)} columns")
    return table.insert(source.toDF(*names))


def _update(t: Tables, ts: list[str]) -> int:
    target, assigned, where = _cut(ts, "SET", "WHERE")
    table, _, alias = _target(t, target)
    new = _assignments(assigned)
    names = _columns(table, list(new))
    condition = _text(where) or "true"
    values = ", ".join(f"{e} AS `_v_{n}`" for n, e in zip(names, new.values()))
    hit = lambda rows: _sql(t, f"SELECT *, {values} FROM {{d_}} AS {alias} WHERE {condition}", d_=rows)
    return table.change("update", hit, lambda rows: _rest(t, rows, alias, condition), {n: F.col(f"_v_{n}") for n in names})


def _rest(t: Tables, rows: DataFrame, alias: str, condition: str) -> DataFrame:
    return _sql(t, f"SELECT * FROM {{d_}} AS {alias} WHERE NOT coalesce(({condition}), false)", d_=rows)


def _delete(t: Tables, ts: list[str]) -> int:
    target, where = _cut(ts, "WHERE")
    table, _, alias = _target(t, target)
    condition = _text(where) or "true"
    return table.change("delete", lambda rows: _sql(t, f"SELECT * FROM {{d_}} AS {alias} WHERE {condition}", d_=rows), lambda rows: _rest(t, rows, alias, condition))


def _merge(t: Tables, ts: list[str]) -> int:
    """WHEN MATCHED [AND c] THEN UPDATE SET ... or DELETE, and WHEN NOT MATCHED [AND c] THEN INSERT (...) VALUES (...); each
    once at most. A row of the target that two rows of the source match is an error."""
    target, source, rest = _cut(ts, "USING", "ON")
    table, _, alias = _target(t, target)
    condition, *whens = re.split(r"(?i)\bWHEN\b(?=\s+(?:NOT\s+)?MATCHED\b)", _text(rest))
    schema = table.read().schema
    change = added = None
    for w in whens:
        m = re.fullmatch(r"(?is)\s*(NOT\s+)?MATCHED\s*(?:AND\s+(.*?))?\s*\bTHEN\s+(UPDATE\s+SET|DELETE|INSERT)\b(.*)", w)
        if not m or bool(m[1]) != (m[3].upper() == "INSERT"):
            raise ValueError(f"MERGE does not know: WHEN{w}")
        if m[1]:
            inserted = re.fullmatch(r"(?is)\s*(?:\((.*?)\))?\s*VALUES\s*\((.*)\)\s*", m[4])
            if not inserted:
                raise ValueError(f"MERGE does not know: WHEN{w}")
            names = _columns(table, [c.strip() for c in inserted[1].split(",")]) if inserted[1] else schema.names
            values = ", ".join(f"{v.strip()} AS `{n}`" for n, v in zip(names, _arguments(tokens(inserted[2]))))
            also = f" AND ({m[2]})" if m[2] else ""
            fresh = _sql(t, f"SELECT {values} FROM {_text(source)} WHERE NOT EXISTS (SELECT 1 FROM {{d_}} AS {alias} WHERE {condition}){also}", d_=table.read())
            added = dml.aligned_rows(T.StructType(schema.fields), fresh)
        else:
            change = (m[2] or "true", None if m[3].upper() == "DELETE" else _assignments(tokens(m[4])))
    if change is None:
        return table.insert(added)
    also, new = change
    names = _columns(table, list(new or {}))
    values = "".join(f", {e} AS `_v_{n}`" for n, e in zip(names, (new or {}).values()))
    matched = f"FROM {{d_}} AS {alias} JOIN {_text(source)} ON ({condition}) AND ({also})"
    where = table.read().select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row"))
    if not _sql(t, f"SELECT {alias}._row {matched} GROUP BY {alias}._row HAVING count(*) > 1", d_=where).isEmpty():
        raise Violation("several rows of the source match one of the target")
    exists = f"EXISTS (SELECT 1 FROM {_text(source)} WHERE ({condition}) AND ({also}))"
    hit = (lambda rows: _sql(t, f"SELECT {alias}.*{values} {matched}", d_=rows)) if new is not None else lambda rows: _sql(t, f"SELECT * FROM {{d_}} AS {alias} WHERE {exists}", d_=rows)
    keep = lambda rows: _sql(t, f"SELECT * FROM {{d_}} AS {alias} WHERE NOT {exists}", d_=rows)
    return table.change("merge", hit, keep, None if new is None else {n: F.col(f"_v_{n}") for n in names}, added)


#: How the statements begin.
STATEMENTS = {("INSERT", "INTO"): _insert, ("UPDATE",): _update, ("DELETE", "FROM"): _delete, ("MERGE", "INTO"): _merge, ("TRUNCATE", "TABLE"): lambda t, ts: _target(t, ts)[0].truncate()}


def change_by_sql(t: Tables, text: str) -> DataFrame | None:
    """Run text if it is one of STATEMENTS: one row with the table's new version; None otherwise."""
    ts = [x for x in tokens(text.strip().rstrip(";")) if not x.startswith(("--", "/*"))]
    for words, run in STATEMENTS.items():
        at = 0
        for w in words:
            at = _next(ts, at)
            if at >= len(ts) or ts[at].upper() != w:
                break
            at += 1
        else:
            return t.spark.createDataFrame([(" ".join(words), run(t, ts[at:]))], "statement string, version int")
    return None
