"""Tables that can be changed: Parquet files with a manifest per version.

A change writes new files and a new manifest; readers of older versions are not disturbed, and any version can be read
again. A change rewrites only the files that hold rows it touches; finding them is a scan with the condition pushed
down. Two changes from the same version conflict: the manifest of a version can be created once only. A manifest names
the files that were added and removed, and all files only every FULL versions; what the driver holds of them is no more
than Spark's own list of the files it reads.

Constraints hold for every version: primary and unique keys, NOT NULL, CHECK, and foreign keys, which both their tables
watch. Triggers are SQL texts that are kept with the table. A change is atomic for its table; what it causes in others, by
ON DELETE or triggers, are changes of their own.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import dml

#: Versions between two manifests that name all files.
FULL = 20
#: Triggers that may set off each other in a row.
DEPTH = 16
Rows = Callable[[DataFrame], DataFrame]


class Conflict(Exception):
    """Another change came first."""


class Violation(Exception):
    """Rows break a constraint of the table."""


@dataclass
class ForeignKey:
    """columns refer to parent_columns, a unique key of the table at `parent`; a reference with a null refers to nothing.
    on_delete, for references to rows that go: restrict (refused), cascade (deleted too) or set_null."""

    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "restrict"


@dataclass
class Trigger:
    """What happens on INSERT, UPDATE (of columns, where given) or DELETE.

    For each statement, sql is a query over {old_rows} and {new_rows}, the rows before and after; for each row, one over
    {changed}, a row per changed row with columns old_<name> and new_<name>, nulls where there is none. when is a condition
    that a statement's trigger needs for anything to happen (it may query old_rows and new_rows), and that picks rows of
    changed otherwise. The rows of sql are inserted into the table at target. Without a target they are an objection: if
    there are any, the change is refused. assign, for each row and before the change: new values by column, as expressions
    over old_<name> and new_<name>.
    """

    name: str
    event: str
    sql: str = ""
    target: str | None = None
    when: str | None = None
    columns: list[str] = field(default_factory=list)
    each_row: bool = False
    assign: dict[str, str] = field(default_factory=dict)


def manifest_of(text_of: Callable[[int], str], version: int) -> dict:
    """The manifest of a version with all files: the last full list and the changes since."""
    last = m = json.loads(text_of(version))
    changes = []
    while "files" not in m:
        changes.append(m)
        m = json.loads(text_of(m["version"] - 1))
    files = dict.fromkeys(m["files"])
    for c in reversed(changes):
        for f in c["removed"]:
            del files[f]
        files |= dict.fromkeys(c["added"])
    return last | {"files": list(files)}


def manifest_text(version: int, manifest: dict, removed: list[str], added: list[str]) -> str:
    """What is written of a manifest with all files; a whole one ends with a line break."""
    manifest = manifest | {"version": version, "time": dt.datetime.now(dt.timezone.utc).isoformat(), "removed": removed, "added": added}
    if version % FULL:
        del manifest["files"]
    return json.dumps(manifest) + "\n"


class ChangeableTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._depth = 0

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, schema: T.StructType, unique: list[str] | None = None, checks: list[str] | None = None,
        *, primary: list[str] | None = None, references: list[ForeignKey] | None = None,
    ) -> ChangeableTable:
        """An empty table. Columns that schema says are not nullable, the primary key (unique and never null) or the unique
        key (null parts are equal to nothing), the checks (SQL conditions that no row makes false) and the references
        hold for every version."""
        table = cls(spark, path)
        if primary:
            schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in primary, f.metadata) for f in schema.fields])
        keys = [asdict(k) for k in references or []]
        for k in keys:
            parent = table if k["parent"].rstrip("/") == table.path else cls(spark, k["parent"])
            own = primary or unique or [] if parent is table else parent._latest()["unique"]
            if sorted(own) != sorted(k["parent_columns"]) or len(k["columns"]) != len(own) or k["on_delete"] not in ("restrict", "cascade", "set_null"):
                raise ValueError(f"{k} does not refer to a key of {k['parent']}")
        table._commit(0, {"operation": "create", "schema": schema.jsonValue(), "unique": primary or unique or [], "checks": checks or [], "references": keys, "children": [], "triggers": [], "files": []}, [], [])
        for k in keys:
            parent = cls(spark, k["parent"])
            m = parent._latest()
            parent._next(m | {"children": m["children"] + [k | {"child": table.path}]}, "referenced", [], [])
        return table

    # files and manifests

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str, ending: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(ending)) if fs.exists(p) else []

    def _text(self, version: int) -> str:
        fs, p = self._fs(f"{self.path}/versions/{version:09d}.json")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self, version: int) -> dict:
        return manifest_of(self._text, version)

    def _commit(self, version: int, manifest: dict, removed: list[str], added: list[str]) -> None:
        self._create(f"{self.path}/versions/{version:09d}.json", manifest_text(version, manifest, removed, added))

    def _create(self, path: str, text: str) -> None:
        """Create a file that must not be there: exclusively, as the file system guarantees it."""
        fs, p = self._fs(path)
        url = urlparse(path)
        try:
            if url.scheme in ("", "file"):
                os.makedirs(os.path.dirname(url.path), exist_ok=True)
                with open(url.path, "x", encoding="utf-8") as f:
                    f.write(text)
                return
            out = fs.create(p, False)
        except FileExistsError:
            raise Conflict(f"{path} is there already") from None
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"{path} is there already") from None
        out.write(bytearray(text.encode()))
        out.close()

    def versions(self) -> list[int]:
        """The versions; the last one may still be being written, see _latest."""
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions", ".json") if not n.startswith(".")]

    def history(self) -> DataFrame:
        """version, time, operation and n_files of each version."""
        rows = [(m["version"], m["time"], m["operation"], len(m["files"])) for m in map(self._manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version int, time string, operation string, n_files int")

    def _latest(self) -> dict:
        """The last manifest that is whole: one ends with a line break."""
        return self._manifest(next(v for v in reversed(self.versions()) if self._text(v).endswith("\n")))

    def repair(self) -> list[int]:
        """Delete manifests whose writer died while it wrote; no change may run meanwhile. The versions that are gone."""
        broken = [v for v in self.versions() if not self._text(v).endswith("\n")]
        for v in broken:
            fs, p = self._fs(f"{self.path}/versions/{v:09d}.json")
            fs.delete(p, False)
        return broken

    # reading

    def read(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """The rows of the latest version, of a version, or of the latest one committed by a time."""
        if as_of is not None:
            known = [v for v in self.versions() if dt.datetime.fromisoformat(self._manifest(v)["time"]) <= as_of.astimezone(dt.timezone.utc)]
            if not known:
                raise ValueError(f"no version by {as_of}")
            version = known[-1]
        return self._rows(self._latest() if version is None else self._manifest(version))

    def _rows(self, manifest: dict, files: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        files = manifest["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files))

    def changes(self, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Old and new rows, as a trigger's transition tables, of the changes after version `since` up to `until`: only
        files that one of the two versions lacks are read."""
        before, after = self._manifest(since), self._latest() if until is None else self._manifest(until)
        old = self._rows(before, sorted(set(before["files"]) - set(after["files"])))
        new = self._rows(after, sorted(set(after["files"]) - set(before["files"])))
        return old.exceptAll(new), new.exceptAll(old)

    # changes

    def _written(self, df: DataFrame, manifest: dict) -> list[str]:
        schema = T.StructType.fromJson(manifest["schema"])
        rows = dml.normalize(df.select(*schema.names), schema)
        for check in manifest["checks"]:
            rows = dml.enforced(rows, F.expr(check), f"constraint {check} is violated")
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return [f"{folder}/{n}" for n in self._names(f"{self.path}/data/{folder}", ".parquet")]

    def _unique(self, new: DataFrame, manifest: dict, against: DataFrame | None) -> None:
        if not (keys := manifest["unique"]):
            return
        if not dml.duplicate_keys(new, keys).isEmpty():
            raise Violation(f"several new rows with one key {keys}")
        if against is not None and not new.join(against, keys, "left_semi").isEmpty():
            raise Violation(f"a new row has the key {keys} of one that is there")

    def _refer(self, new: DataFrame, manifest: dict) -> None:
        """Every reference of the new rows has its parent; a row may refer to itself or another new row of its table."""
        for k in manifest["references"]:
            known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in k["columns"]))
            refs = new.where(known).select(*k["columns"]).distinct()
            parents = ChangeableTable(self.spark, k["parent"]).read().select(*(F.col(p).alias(c) for p, c in zip(k["parent_columns"], k["columns"])))
            if k["parent"].rstrip("/") == self.path:
                parents = parents.unionAll(new.select(*(F.col(p).alias(c) for p, c in zip(k["parent_columns"], k["columns"]))))
            if not refs.join(parents, k["columns"], "left_anti").isEmpty():
                raise Violation(f"{k['columns']} refer to rows that {k['parent']} does not have")

    def _orphaned(self, gone: DataFrame, kept: DataFrame, manifest: dict) -> list[Callable[[], None]]:
        """Check the references to rows that go; what is to be done about them in the children afterwards."""
        todo: list[Callable[[], None]] = []
        for k in manifest["children"]:
            keys = gone.select(*k["parent_columns"]).join(kept, k["parent_columns"], "left_anti").select(*(F.col(p).alias(f"_p_{c}") for p, c in zip(k["parent_columns"], k["columns"])))
            child = self if k["child"] == self.path else ChangeableTable(self.spark, k["child"])
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_p_{c}") for c in k["columns"]))

            def hit(rows: DataFrame, keys: DataFrame = keys, on: Column = on) -> DataFrame:
                return rows.join(keys, on, "left_semi")

            def rest(rows: DataFrame, keys: DataFrame = keys, on: Column = on) -> DataFrame:
                return rows.join(keys, on, "left_anti")

            rows = kept if child is self else child.read()
            if hit(rows).isEmpty():
                continue
            if k["on_delete"] == "restrict":
                raise Violation(f"rows of {k['child']} refer to rows that would go")
            if k["on_delete"] == "cascade":
                todo.append(lambda c=child, h=hit, r=rest: c.change("delete", h, r))
            else:
                nulls = {c: F.lit(None) for c in k["columns"]}
                todo.append(lambda c=child, h=hit, r=rest, n=nulls: c.change("update", h, r, n))
        return todo

    def _fire(self, manifest: dict, event: str, changed: DataFrame, columns: set[str] | None, objections: bool) -> None:
        """Run the triggers of an event: those that may refuse the change, before it, or those with a target, after it."""
        names = T.StructType.fromJson(manifest["schema"]).names
        for g in (Trigger(**g) for g in manifest["triggers"]):
            if g.event != event or not g.sql or (g.target is None) != objections or (columns is not None and g.columns and not columns & set(g.columns)):
                continue
            tables = {"changed": changed} if g.each_row else {f"{side}_rows": changed.where(f"_{side}").select(*(F.col(f"{side}_{n}").alias(n) for n in names)) for side in ("old", "new")}
            if g.each_row and g.when:
                tables = {"changed": changed.where(g.when)}
            elif g.when and self.spark.sql(f"SELECT 1 WHERE {g.when}", **{k: v for k, v in tables.items() if f"{{{k}}}" in g.when}).isEmpty():
                continue
            result = self.spark.sql(g.sql, **{k: v for k, v in tables.items() if f"{{{k}}}" in g.sql})
            if g.target is None:
                if not result.isEmpty():
                    raise Violation(f"trigger {g.name} refuses the change")
                continue
            if self._depth >= DEPTH:
                raise Violation(f"trigger {g.name}: more than {DEPTH} triggers set off each other")
            target = ChangeableTable(self.spark, g.target)
            target._depth = self._depth + 1
            target.insert(result)

    def _assigned(self, manifest: dict, event: str, pairs: DataFrame, columns: set[str] | None) -> DataFrame:
        """pairs of old and new values after the triggers that set new values."""
        for g in (Trigger(**g) for g in manifest["triggers"]):
            if g.event == event and g.assign and (columns is None or not g.columns or columns & set(g.columns)):
                hit = F.coalesce(F.expr(g.when), F.lit(False)) if g.when else F.lit(True)
                pairs = pairs.withColumns({f"new_{c}": F.when(hit, F.expr(e).cast(pairs.schema[f"new_{c}"].dataType)).otherwise(F.col(f"new_{c}")) for c, e in g.assign.items()})
        return pairs

    def _pairs(self, schema: T.StructType, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
        """Rows of one side as pairs, the other side null."""
        rows = old if old is not None else new
        value = lambda side, f: F.col(f.name).alias(f"{side}_{f.name}") if (side == "old") == (old is not None) else F.lit(None).cast(dml.value_type(f)).alias(f"{side}_{f.name}")
        both = [value(side, f) for side in ("old", "new") for f in schema.fields]
        return rows.select(*both, F.lit(old is not None).alias("_old"), F.lit(new is not None).alias("_new"))

    def _next(self, manifest: dict, operation: str, gone: list[str], new: list[str]) -> int:
        left = set(gone)
        files = [f for f in manifest["files"] if f not in left] + new
        self._commit(manifest["version"] + 1, manifest | {"operation": operation, "files": files}, gone, new)
        return manifest["version"] + 1

    def add_trigger(self, trigger: Trigger) -> int:
        """Keep a trigger with the table, from the new version on."""
        if trigger.event not in ("INSERT", "UPDATE", "DELETE") or bool(trigger.sql) == bool(trigger.assign) or (trigger.assign and trigger.event == "DELETE"):
            raise ValueError(f"no trigger: {trigger}")
        m = self._latest()
        if any(g["name"] == trigger.name for g in m["triggers"]):
            raise ValueError(f"trigger {trigger.name} is there already")
        return self._next(m | {"triggers": [*m["triggers"], asdict(trigger)]}, f"trigger {trigger.name}", [], [])

    def drop_trigger(self, name: str) -> int:
        m = self._latest()
        return self._next(m | {"triggers": [g for g in m["triggers"] if g["name"] != name]}, f"drop trigger {name}", [], [])

    def insert(self, df: DataFrame, defaults: dict[str, Column] | None = None) -> int:
        """Add rows; columns that df lacks take their default or null. The new version."""
        m = self._latest()
        schema = T.StructType.fromJson(m["schema"])
        rows = dml.aligned_rows(schema, df, defaults)
        if any(g["event"] == "INSERT" and g["assign"] for g in m["triggers"]):
            pairs = self._assigned(m, "INSERT", self._pairs(schema, None, rows), None)
            rows = pairs.select(*(F.col(f"new_{n}").alias(n) for n in schema.names))
        self._unique(rows, m, self._rows(m) if m["files"] else None)
        self._refer(rows, m)
        new = self._written(rows, m)
        inserted = self._pairs(schema, None, self._rows(m, new))  # what was written, however rows was made
        self._fire(m, "INSERT", inserted, None, True)
        version = self._next(m, "insert", [], new)
        self._fire(m, "INSERT", inserted, None, False)
        return version

    def change(self, operation: str, hit: Rows, rest: Rows, values: dict[str, Column] | None = None, added: DataFrame | None = None, new_keys: bool = False) -> int:
        """Delete the rows that hit picks from the table's rows, or give them the values, computed from the old ones; rest
        picks the others. values may use columns that hit adds. added: rows to add besides; new_keys: none of
        them has the unique key of another or of a row that is there. Rows must not be picked twice.
        """
        m = self._latest()
        schema = T.StructType.fromJson(m["schema"])
        every = self._rows(m)
        found = hit(every.select("*", F.col("_metadata.file_path").alias("_file"))).select("_file").distinct().collect() if m["files"] else []
        gone = sorted(r[0].rpartition("/data/")[2] for r in found)  # no more than the manifest lists
        if not gone:
            return self._next(m, operation, [], []) if added is None else self.insert(added)
        old = self._rows(m, gone)
        untouched = self._rows(m, sorted(set(m["files"]) - set(gone)))
        kept, event = rest(old).select(*schema.names), "DELETE" if values is None else "UPDATE"
        columns = None if values is None else set(values)
        if values is None:
            pairs = self._pairs(schema, hit(old), None)
            content = kept
        else:
            kinds = {f.name: dml.value_type(f) for f in schema.fields}
            new = {n: values[n].cast(kinds[n]) if n in values else F.col(n) for n in schema.names}
            pairs = hit(old).select(*(F.col(n).alias(f"old_{n}") for n in schema.names), *(e.alias(f"new_{n}") for n, e in new.items()), F.lit(True).alias("_old"), F.lit(True).alias("_new"))
            pairs = self._assigned(m, "UPDATE", pairs, columns)
            changed = pairs.select(*(F.col(f"new_{n}").alias(n) for n in schema.names))
            content = kept.unionAll(changed)
            given = columns | {c for g in m["triggers"] if g["event"] == "UPDATE" for c in g["assign"]}
            if added is not None or any(given & set(k["columns"]) for k in m["references"]):
                self._refer(changed if added is None else changed.unionAll(added), m)
            if given & set(m["unique"]) or (added is not None and not new_keys):
                self._unique(content if added is None else content.unionAll(added), m, untouched)
        if added is not None:
            content = content.unionAll(added)
        todo = self._orphaned(pairs.select(*(F.col(f"old_{n}").alias(n) for n in schema.names)), untouched.unionAll(content), m) if m["children"] else []
        self._fire(m, event, pairs, columns, True)
        if added is not None:
            self._fire(m, "INSERT", self._pairs(schema, None, added), None, True)
        version = self._next(m, operation, gone, self._written(content, m))
        for do in todo:
            do()
        self._fire(m, event, pairs, columns, False)
        if added is not None:
            self._fire(m, "INSERT", self._pairs(schema, None, added), None, False)
        return version

    def delete(self, where: Column) -> int:
        """Remove the rows for which where is true."""
        return self.change("delete", lambda rows: rows.where(where), lambda rows: dml.delete_rows(rows, where))

    def update(self, where: Column, **new: Column) -> int:
        """Give the rows for which where is true new values, computed from the old ones."""
        return self.change("update", lambda rows: rows.where(where), lambda rows: dml.delete_rows(rows, where), new)

    def upsert(self, df: DataFrame, keys: list[str] | None = None) -> int:
        """Rows of df replace those with equal keys (the unique key by default; null is equal to null) and are added
        otherwise."""
        m = self._latest()
        keys = keys or m["unique"]
        if not keys:
            raise ValueError("no keys")
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise Violation(f"several new rows with one key {keys}")
        schema = T.StructType.fromJson(m["schema"])
        rows = dml.aligned_rows(schema, df)
        if not m["files"]:
            return self.insert(rows)
        source = rows.select(*(F.col(n).alias(f"_s_{n}") for n in schema.names))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys))
        added = source.join(self._rows(m), same, "left_anti").select(*(F.col(f"_s_{n}").alias(n) for n in schema.names))
        values = {n: F.col(f"_s_{n}") for n in schema.names if n not in keys}
        return self.change("upsert", lambda r: r.join(source, same), lambda r: r.join(source, same, "left_anti"), values, added, set(keys) == set(m["unique"]))

    def truncate(self) -> int:
        """Remove all rows, without triggers; refused while rows of other tables refer to them."""
        m = self._latest()
        for k in m["children"]:
            known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in k["columns"]))
            if k["child"] != self.path and not ChangeableTable(self.spark, k["child"]).read().where(known).isEmpty():
                raise Violation(f"rows of {k['child']} refer to rows that would go")
        return self._next(m, "truncate", m["files"], [])

    def restore(self, version: int) -> int:
        """Make an older version the latest again."""
        m, old = self._latest(), self._manifest(version)["files"]
        return self._next(m, f"restore {version}", sorted(set(m["files"]) - set(old)), sorted(set(old) - set(m["files"])))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the manifests before the last `keep` versions, and data folders none of these uses. No change may run
        meanwhile. The folders that are gone."""
        versions = self.versions()
        first = self._manifest(versions[-keep:][0])  # it must not need the ones that go
        fs, p = self._fs(f"{self.path}/versions/{first['version']:09d}.json")
        draft = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")[1]
        out = fs.create(draft, True)
        out.write(bytearray((json.dumps(first) + "\n").encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(draft, p)
        used = {f.split("/")[0] for v in versions[-keep:] for f in self._manifest(v)["files"]}
        for v in versions[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{v:09d}.json")
            fs.delete(p, False)
        gone = [n for n in self._names(f"{self.path}/data", "") if n not in used]
        for n in gone:
            fs, p = self._fs(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return gone
