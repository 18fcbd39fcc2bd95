"""Versions of a set of tables: one manifest commits them all, readers pin what they read, writers race by compare-and-swap.

A store is a folder::

    data/<table>/<id>/          Parquet files of one write, never changed
    manifests/m-00000007.json   version 7: the folders of every table, and tokens of what it holds
    leases/<id>.json            a reader's (or writer's) folders and how long they are kept for it

A version exists once its manifest does.  Manifests are made under another name and moved to their own, which fails where it is
taken, so of two writers of one number the second gets ``Conflict``; a writer that fails between tables leaves no manifest and so
changes nothing (DML-17, STR-8).  Reports of a crawl that goes on read one pinned version throughout (STR-9).

Tables are whole or hash-bucketed; of a bucketed table, a merge rewrites the buckets that the incoming rows fall into and takes over the
others' folders as they are.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.merge import Rule, merged_row
from loomwork.plans.lineage import discard, written

#: Column that holds a row's bucket in the files.
BUCKET = "loomwork_bucket"
#: Bytes of incoming rows that are broadcast to the buckets they change, which the driver builds; more are joined by shuffling.
MOST_INCOMING = 4 << 20

Check = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Files:
    """The few file operations a store needs, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.path(root)).toString().rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> dict | None:
        """A JSON file; None if it is not there (any more)."""
        at = self.path(f"{self.root}/{name}")
        try:
            stream = self.fs.open(at)
        except Exception:
            if self.fs.exists(at):
                raise
            return None
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        stream = self.fs.create(self.path(f"{self.root}/{name}"), True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()

    def publish(self, name: str, value: dict) -> bool:
        """Make a whole file that was not there; False if it is there already.

        A local file is linked, elsewhere it is renamed; both fail on a taken name (HDFS and local folders; an object store
        whose rename replaces files is not fit for stores with several writers).
        """
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        self.write(draft, value)
        here, there = self.path(f"{self.root}/{draft}"), self.path(f"{self.root}/{name}")
        try:
            if self.fs.getUri().getScheme() == "file":
                try:
                    os.link(here.toUri().getPath(), there.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return bool(self.fs.rename(here, there)) if not self.fs.exists(there) else False
        finally:
            self.fs.delete(here, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Version:
    """A manifest: what each table's folders are, and the tokens of the writes that it holds."""

    number: int
    tables: dict[str, dict]
    tokens: dict[str, int] = field(default_factory=dict)

    def folders(self, name: str) -> list[str]:
        entry = self.tables.get(name)
        if entry is None:
            return []
        return [f for _, f in sorted(entry["buckets"].items(), key=lambda x: int(x[0]))] if "buckets" in entry else [entry["folder"]]

    def all_folders(self) -> set[str]:
        return {f for name in self.tables for f in self.folders(name)}


class Snapshot:
    """One pinned version, read as often as needed: the same rows each time, whatever is committed meanwhile."""

    def __init__(self, store: SnapshotStore, spark: SparkSession, version: Version, lease: str | None = None):
        self.store, self.spark, self.version, self.lease = store, spark, version, lease

    @property
    def number(self) -> int:
        return self.version.number

    def __contains__(self, name: str) -> bool:
        return name in self.version.tables

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of the version; one that is not there is empty, with the columns of ``schema``."""
        entry = self.version.tables.get(name)
        schema = schema or (entry and entry["schema"])
        if entry is None or not self.version.folders(name):
            if schema is None:
                raise KeyError(f"no table {name} in version {self.number}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.files(self.spark).root}/{f}" for f in self.version.folders(name)])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in sorted(self.version.tables)}

    def renew(self) -> None:
        """Keep the version for another lease from now on."""
        if self.lease:
            self.store._write_lease(self.store.files(self.spark), self.lease, self.version.all_folders(), self.number)


class SnapshotStore:
    """Tables that are written together and read together; see the module.

    ``keep`` versions are kept in any case, leased ones as long as their lease runs.  ``check`` gets the tables of a commit before
    anything is written and returns what to write, or raises.
    """

    def __init__(self, folder: str, keep: int = 2, lease_seconds: float = 3600, check: Check | None = None):
        self.folder, self.keep, self.lease_seconds, self.check = folder.rstrip("/"), keep, lease_seconds, check

    def files(self, spark: SparkSession) -> Files:
        return Files(spark, self.folder)

    # Reading -----------------------------------------------------------------------------------

    def numbers(self, spark: SparkSession) -> list[int]:
        found = (re.fullmatch(r"m-(\d+)\.json", n) for n in self.files(spark).names("manifests"))
        return [int(m[1]) for m in found if m]

    def _version(self, files: Files, number: int) -> Version | None:
        raw = files.read(f"manifests/m-{number:08d}.json")
        return raw and Version(raw["number"], raw["tables"], raw["tokens"])

    def latest(self, spark: SparkSession) -> Version:
        """The newest version; number 0, without tables, in a new store."""
        files = self.files(spark)
        for number in reversed(self.numbers(spark)):
            version = self._version(files, number)
            if version:
                return version
        return Version(0, {})

    def _write_lease(self, files: Files, lease: str, folders: set[str], number: int) -> None:
        files.write(f"leases/{lease}.json", {"number": number, "folders": sorted(folders), "until": time.time() + self.lease_seconds})

    @contextmanager
    def reader(self, spark: SparkSession, number: int | None = None) -> Iterator[Snapshot]:
        """A version, the newest unless ``number`` is given, pinned until the block ends or the lease runs out.

        The lease is written first and the manifest looked for again after it: a clean-up either sees the lease or has
        taken the manifest away before, and then another version is pinned.
        """
        files, lease = self.files(spark), uuid.uuid4().hex
        while True:
            version = self.latest(spark) if number is None else self._version(files, number)
            if version is None:
                raise KeyError(f"no version {number}")
            self._write_lease(files, lease, version.all_folders(), version.number)
            if version.number == 0 or self._version(files, version.number):
                break
        try:
            yield Snapshot(self, spark, version, lease)
        finally:
            files.delete(f"leases/{lease}.json")

    # Writing -----------------------------------------------------------------------------------

    def commit(self, changes: dict[str, DataFrame], expected: int | None = None, token: tuple[str, int] | None = None) -> int:
        """Write ``changes`` as the next version, the other tables as they are; returns its number.

        ``expected`` is the version that the changes were made from: if another one is the newest, or becomes it before this one,
        ``Conflict`` is raised and nothing changes.  A ``token (name, n)`` marks a write that may be repeated: one that is not
        above the newest version's of that name changes nothing.
        """
        spark = next(iter(changes.values())).sparkSession
        with self._writing(spark, expected, token) as (version, write, publish):
            if version is None:
                return self.latest(spark).number
            checked = self.check(changes) if self.check else changes
            return publish({**version.tables, **{name: write(name, df) for name, df in checked.items()}})

    @contextmanager
    def _writing(self, spark: SparkSession, expected: int | None, token: tuple[str, int] | None):
        files, version, lease, made = self.files(spark), self.latest(spark), uuid.uuid4().hex, []
        if token and version.tokens.get(token[0], -1) >= token[1]:
            yield None, None, None
            return
        if expected is not None and version.number != expected:
            raise Conflict(f"version {version.number} is newer than {expected}")
        base = version.all_folders()

        def fresh(name: str) -> str:
            made.append(f"data/{name}/{uuid.uuid4().hex}")
            self._write_lease(files, lease, base | set(made), version.number)
            return made[-1]

        def write(name: str, df: DataFrame) -> dict:
            folder = fresh(name)
            df.write.parquet(f"{files.root}/{folder}")
            return {"folder": folder, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}

        def publish(tables: dict[str, dict]) -> int:
            if files.read(f"leases/{lease}.json") is None:
                raise Conflict("the lease of this write ran out and its files were cleaned up")
            tokens = {**version.tokens, **({token[0]: token[1]} if token else {})}
            number = version.number + 1
            if not files.publish(f"manifests/m-{number:08d}.json", {"number": number, "tables": tables, "tokens": tokens}):
                raise Conflict(f"version {number} was committed by another writer")
            made.clear()
            return number

        write.fresh = fresh
        try:
            yield version, write, publish
        finally:
            for folder in made:  # what a failed commit has written
                files.delete(folder)
            files.delete(f"leases/{lease}.json")
        self.clean(spark)

    def clean(self, spark: SparkSession) -> int:
        """Delete versions beyond ``keep`` that nobody has leased, and their folders and those of leases that ran out, unless a version
        or lease names them; returns how many folders."""
        files = self.files(spark)
        known = {n: v for n in self.numbers(spark) if (v := self._version(files, n))}

        def leases() -> dict[str, dict]:
            return {n: x for n in files.names("leases") if n.endswith(".json") and (x := files.read(f"leases/{n}"))}

        live = lambda held: [x for x in held.values() if x["until"] > time.time()]
        pinned = {x["number"] for x in live(leases())}
        old = [n for n in sorted(known)[: -self.keep] if n not in pinned]
        for number in old:
            files.delete(f"manifests/m-{number:08d}.json")
        held = leases()  # again: a reader may have pinned one of them before its manifest went
        over = {n: x for n, x in held.items() if x["until"] <= time.time()}
        for name in over:
            files.delete(f"leases/{name}")
        kept = {f for x in live(held) for f in x["folders"]} | {f for n, v in known.items() if n not in old for f in v.all_folders()}
        gone = ({f for n in old for f in known[n].all_folders()} | {f for x in over.values() for f in x["folders"]}) - kept
        for folder in gone:
            if not any(k.startswith(f"{folder}/") for k in kept):  # a bucketed write's folder holds buckets that may be in use
                files.delete(folder)
        return len(gone)

    # Bucketed tables ---------------------------------------------------------------------------

    def merge(self, name: str, incoming: DataFrame, keys: list[str], rules: dict[str, Rule], schema: str, buckets: int = 64, ignore_changes: tuple[str, ...] = (), token: tuple[str, int] | None = None) -> dict[str, int]:
        """Merge ``incoming`` (one row for each key) into a bucketed table by ``rules`` (see ``operators.merge.merge``).

        Returns the numbers of rows by action (created, updated, unchanged).  Only buckets that rows come for are read and
        written.  The table's rows are not shuffled: a small batch is broadcast to them, a large one shuffled beside them.
        """
        spark = incoming.sparkSession
        with self._writing(spark, None, token) as (version, write, publish):
            if version is None:
                return {"created": 0, "updated": 0, "unchanged": 0}
            entry = version.tables.get(name) or {"buckets": {}, "keys": keys, "n": buckets, "schema": schema}
            if entry["keys"] != keys:
                raise ValueError(f"{name} is bucketed by {entry['keys']}")
            rows = written(incoming.select("*", bucket_of(keys, entry["n"]).alias(BUCKET)), "incoming")
            touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())
            if not touched:
                discard(rows)
                return {"created": 0, "updated": 0, "unchanged": 0}
            here = [entry["buckets"][str(b)] for b in touched if str(b) in entry["buckets"]]
            current = spark.read.schema(entry["schema"]).parquet(*[f"{self.files(spark).root}/{f}" for f in here]) if here else spark.createDataFrame([], entry["schema"])
            changed = changed_rows(current.withColumn(BUCKET, bucket_of(keys, entry["n"])), rows, keys, rules, ignore_changes)
            folder = write.fresh(name)
            changed.write.partitionBy(BUCKET).parquet(f"{self.files(spark).root}/{folder}")
            after = spark.read.schema(f"{entry['schema']}, action string").parquet(*[f"{self.files(spark).root}/{folder}/{BUCKET}={b}" for b in touched])
            counts = {r.action: r.n for r in after.where("action IS NOT NULL").groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
            if set(counts) - {"unchanged"} or ignore_changes:
                publish({**version.tables, name: {**entry, "buckets": {**entry["buckets"], **{str(b): f"{folder}/{BUCKET}={b}" for b in touched}}}})
            discard(rows)
        return {a: counts.get(a, 0) for a in ("created", "updated", "unchanged")}


def bucket_of(keys: list[str], n: int) -> Column:
    """The bucket of a row: by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def changed_rows(current: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Rule], ignore_changes: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``current`` after ``incoming``, with ``action``.

    A batch of up to ``MOST_INCOMING`` bytes is broadcast, and the rows of ``current`` stay where they are read: they meet the incoming
    row of their key in a join that keeps them all, and incoming rows whose key is not there follow.  A larger batch meets them in one
    full join, each side shuffled once.  Null keys match nothing.
    """
    columns = [c for c in current.columns if c != BUCKET]
    types = dict(current.dtypes)
    given = incoming.select(BUCKET, *[(F.col(c) if c in incoming.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns])
    weight = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in columns])
    few = (given.agg(F.sum(weight)).first()[0] or 0) <= MOST_INCOMING
    old = current.select(F.struct(*columns).alias("old"), BUCKET, *[F.col(k).alias(f"_{k}") for k in keys])
    new = given.select(F.struct(*columns).alias("new"), F.col(BUCKET).alias("_bucket"), *[F.col(k).alias(f"_{k}") for k in keys])
    on = [f"_{k}" for k in keys]
    values, action = merged_row(columns, types, keys, rules, ignore_changes)
    if not few:
        both = old.join(new, on, "full_outer")
        return both.select(*values, action.alias("action"), F.coalesce(BUCKET, "_bucket").alias(BUCKET))
    met = old.join(F.broadcast(new.drop("_bucket")), on, "left")
    kept = met.select(*values, action.alias("action"), BUCKET)
    there = current.select(*keys).join(F.broadcast(given.select(*keys)), keys, "left_semi")
    there = written(there.distinct(), "there")
    fresh = given.join(F.broadcast(there), keys, "left_anti").select(*columns, F.lit("created").alias("action"), BUCKET)
    return kept.unionByName(fresh)


class SnapshotTable:
    """A store of one table."""

    def __init__(self, folder: str, keep: int = 2):
        self.store = SnapshotStore(folder, keep)

    def versions(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(number, folders) of the versions that are there, in order."""
        files = self.store.files(spark)
        return [(n, " ".join(v.folders("table"))) for n in self.store.numbers(spark) if (v := self.store._version(files, n))]

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The newest version, or an empty table; not pinned."""
        return Snapshot(self.store, spark, self.store.latest(spark)).table("table", schema)

    def swap(self, df: DataFrame, expected: int | None = None) -> int:
        """Write ``df`` as the next version; old ones beyond ``keep`` go afterwards."""
        return self.store.commit({"table": df}, expected)

    def merge(self, incoming: DataFrame, keys: list[str], rules: dict[str, Rule], schema: str, **options) -> dict[str, int]:
        """See ``SnapshotStore.merge``."""
        return self.store.merge("table", incoming, keys, rules, schema, **options)


def changes_between(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., change, old, new)``: rows added, removed or changed between two versions of a table, as structs of the other columns."""
    rest = [c for c in before.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(*rest).alias(name))
    both = side(before, "old").join(side(after, "new"), keys, "full_outer")
    differ = reduce(lambda a, b: a | b, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in rest], F.lit(False))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differ, "changed")
    return both.select(*keys, change.alias("change"), "old", "new").where("change IS NOT NULL")
