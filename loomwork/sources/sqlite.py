"""A SQLite file as a partitioned, read-only data source (SRC-3 to SRC-5).

Columns have the type of their affinity: by SQLite's rules a declared type with INT in it is an integer, with CHAR, CLOB or TEXT a text,
with REAL, FLOA or DOUB a real; everything else is read as text.  SQLite holds any value in any column; one that does not
fit its column's type is null.  Comparisons with constants are pushed into SQLite where the session allows it
(``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from loomwork.plans.shipping import ship

#: Parts of a declared type and the Spark type that they stand for; the first that is found counts.
AFFINITIES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
#: Comparisons that SQLite makes as Spark does, on columns of integers, reals and texts.
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def affinity(declared: str) -> str:
    return next((spark for part, spark in AFFINITIES if part in declared.upper()), "string")


def _fitting(kind: str, value: object) -> object:
    """A value of SQLite as one of the column's type, or null."""
    if value is None:
        return None
    if kind == "string":
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if kind == "double":
        return float(value) if isinstance(value, (int, float)) else None
    return value if isinstance(value, int) else None


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_names(path: str) -> list[str]:
    with _open(path) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) of each column in order."""
    with _open(path) as db:
        return [(r[1], affinity(r[2] or "")) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]


class _Range(InputPartition):
    """Row ids from ``first`` to ``last``; the whole table without them (a table WITHOUT ROWID has none)."""

    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))
        self.columns = table_columns(self.path, self.table)
        self.conditions: list[tuple[str, list]] = []

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        kinds = [t for _, t in self.columns]
        names = ", ".join(_quoted(c) for c, _ in self.columns)
        ranges = [] if part.first is None else [("rowid BETWEEN ? AND ?", [part.first, part.last])]
        conditions = [*ranges, *self.conditions]
        where = f" WHERE {' AND '.join(c for c, _ in conditions)}" if conditions else ""
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)}{where}", [v for _, values in conditions for v in values]):
                yield tuple(map(_fitting, kinds, row))


class PushingReader(SqliteReader):
    """With comparisons pushed into SQLite; Spark takes it only where its filter pushdown for Python sources is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of integer columns with integers and tests for null; Spark makes all others itself.

        Texts and reals may hold values that don't fit and are null to Spark, so their comparisons stay with it.
        """
        kinds = dict(self.columns)
        for f in filters:
            name = f.attribute[0] if isinstance(f, (IsNotNull, *COMPARISONS)) and len(f.attribute) == 1 else None
            if kinds.get(name) != "bigint" or (not isinstance(f, IsNotNull) and type(f.value) is not int):
                yield f
            elif isinstance(f, IsNotNull):
                self.conditions.append((f"typeof({_quoted(name)}) = 'integer'", []))
            else:
                self.conditions.append((f"typeof({_quoted(name)}) = 'integer' AND {_quoted(name)} {COMPARISONS[type(f)]} ?", [f.value]))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...)``, split by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in table_columns(self.options["path"], self.options["table"]))

    def reader(self, schema) -> SqliteReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(self.options)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).option("pushdown", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()).load()
