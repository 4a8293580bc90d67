"""Tables of a data folder, read lazily and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of the test data.
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "t_header t_detail customers category category_sub"
).split()


class Tables:
    """tables.lineitem reads <folder>/lineitem.parquet; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: Tables that can be changed, by name; they hide those of the folder.
        self.changeable: dict[str, object] = {}

    def attach(self, name: str, table: object) -> None:
        """Make a changeable table known by a name, to queries and to INSERT, UPDATE, DELETE and MERGE."""
        self.changeable[name.lower()] = table

    def names(self) -> list[str]:
        return sorted({*NAMES, *self.changeable})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self.changeable:
            return self.changeable[name].read()
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run text with the named tables bound as {name}: no temporary view outlives the call."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def register_views(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Create a temporary view per table, for interactive SQL."""
    tables = Tables(spark, folder)
    for name in names or NAMES:
        getattr(tables, name).createOrReplaceTempView(name)


def table_sizes(tables: Tables, names: list[str]) -> DataFrame:
    """table_name, n_columns, n_files and n_bytes, from the files' names and sizes: no data is read."""
    rows = []
    for n in names:
        df = getattr(tables, n)
        files = df.inputFiles()
        rows.append((n, len(df.columns), len(files), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))))
    return tables.spark.createDataFrame(rows, "table_name string, n_columns int, n_files int, n_bytes bigint")


def table_columns(tables: Tables, names: list[str]) -> DataFrame:
    """table_name, column_name, position (from 1), data_type and is_nullable, as a database's catalog tables list them."""
    rows = [(n, f.name, i, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(getattr(tables, n).schema.fields, 1)]
    return tables.spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string, is_nullable boolean")
