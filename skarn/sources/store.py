"""Several keyed tables under one manifest: files first, then one atomic commit.

    path/manifest/00000007.json    the tables and values as of version 7
    path/data/<table>/<unique>     files of one write, in folders by key bucket

A version names the newest folder of every key bucket of every table, so a reader lists one folder
and opens only what is current. Files that no manifest names, such as those of a writer that died,
are never seen. Two writers who started from one version can't both commit: the second one's
manifest has the same number, which exists, and it fails with Conflict.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.windows import best_row

BUCKETS = 64


class Conflict(Exception):
    """Another writer has committed since this transaction began, or the caller's revision is stale."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of all manifests, also of one that is not complete yet."""
        p = self.at(f"{self.path}/manifest")
        names = [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict | None:
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.at(f"{self.path}/manifest/{version:08d}.json")), "UTF-8")
        try:
            return json.loads(text)
        except ValueError:  # its writer died, or is still at it
            return None

    def manifest(self, version: int | None = None) -> dict:
        """The newest complete version, or the given one."""
        for v in reversed(self.versions()):
            if (version is None or v == version) and (found := self._manifest(v)) is not None:
                return found
        if version is not None:
            raise ValueError(f"no version {version}")
        return {"version": -1, "tables": {}, "values": {}}

    def value(self, name: str, default: object = None) -> object:
        """A named value, such as a watermark."""
        return self.manifest()["values"].get(name, default)

    def table(self, name: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
        """The rows of a table. schema: its columns, should it hold nothing yet."""
        return self._read(self.manifest(version), name, schema)

    def _read(self, manifest: Mapping, name: str, schema: T.StructType | str, buckets: Sequence[int] | None = None) -> DataFrame:
        folders = manifest["tables"].get(name, {"folders": {}})["folders"]
        paths = [f"{self.path}/{p}" for b, p in sorted(folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def clean(self, keep: int = 10) -> int:
        """Deletes all but the newest `keep` manifests and the folders that none of them names; for when no writer is at work. Returns the number of folders."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self.fs.delete(self.at(f"{self.path}/manifest/{v:08d}.json"), False)
        known = [m for v in self.versions() if (m := self._manifest(v))]
        maps = [t["folders"] for m in known for t in m["tables"].values()] + [t for m in known for s in m["values"].get("snapshots", {}).values() for t in s.values()]
        used = {p.split("/bucket=")[0] for folders in maps for p in folders.values()}
        gone = 0
        data = self.at(f"{self.path}/data")
        for t in self.fs.listStatus(data) if self.fs.exists(data) else []:
            for folder in self.fs.listStatus(t.getPath()):
                if f"data/{t.getPath().getName()}/{folder.getPath().getName()}" not in used:
                    gone += self.fs.delete(folder.getPath(), True)
        return gone


class Transaction:
    """Changes of several tables and values that are seen together or not at all."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.next = json.loads(json.dumps(self.base))
        self.next["version"] = max([-1, *store.versions()]) + 1

    def set(self, name: str, value: object) -> None:
        self.next["values"][name] = value

    def revision(self, name: str) -> int:
        """How often a table has been written."""
        return self.next["tables"].get(name, {"revision": 0})["revision"]

    def expect(self, name: str, revision: int) -> None:
        """Fails if the table has been written since the caller saw that revision."""
        if self.revision(name) != revision:
            raise Conflict(f"{name} is at revision {self.revision(name)}, not {revision}")

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The table as this transaction sees it, its own writes included."""
        return self.store._read(self.next, name, schema)

    def upsert(self, name: str, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS, split: int = 1) -> None:
        """Rows of new replace those with their key.

        Of rows of new with one key, the one with the largest `order` columns counts (of equal ones the
        largest in all columns), so a table holds a key once. Rows with a null key are kept as any other
        key. The number of key buckets is the table's own from its first write on; only the buckets that
        new touches are written again, each by `split` tasks.
        """
        known = self.next["tables"].get(name)
        if known and known["keys"] != list(keys):
            raise ValueError(f"{name} has the keys {known['keys']}")
        count = known["buckets"] if known else buckets
        key = F.xxhash64(*[F.col(k).cast("string") for k in keys])
        bucket = F.pmod(key, F.lit(count)).cast("int")
        rest = [c for c in new.columns if c not in keys]
        one = best_row(new, list(keys), [*order, *[c for c in rest if c not in order]]) if rest else new.distinct()
        dealt = one.select(*new.columns).withColumn("bucket", bucket)
        touched = [r[0] for r in dealt.select("bucket").distinct().collect()]  # at most `count` numbers
        if not touched:
            return
        old = self.store._read(self.next, name, new.schema, touched).withColumn("bucket", bucket)
        same = None
        for k in keys:
            eq = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
            same = eq if same is None else same & eq
        kept = old.alias("o").join(dealt.select(*keys).alias("n"), same, "left_anti")
        merged = kept.unionByName(dealt, allowMissingColumns=True)
        self._write(name, merged.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(split))), list(keys), count)

    def _write(self, name: str, rows: DataFrame, keys: list[str], count: int) -> None:
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(f"{self.store.path}/{folder}")
        written = [x.getPath().getName() for x in self.store.fs.listStatus(self.store.at(f"{self.store.path}/{folder}")) if x.isDirectory()]
        known = self.next["tables"].setdefault(name, {"keys": keys, "buckets": count, "revision": 0, "folders": {}})
        known["folders"] |= {n.split("=")[1]: f"{folder}/{n}" for n in written if n.startswith("bucket=")}
        known["revision"] += 1

    def reset(self, name: str) -> None:
        """The table is empty from this version on."""
        if name in self.next["tables"]:
            self.next["tables"][name]["folders"] = {}
            self.next["tables"][name]["revision"] += 1

    def commit(self) -> int:
        """The number of the new version; Conflict if another writer has taken it."""
        version = self.next["version"]
        if self.store.manifest()["version"] != self.base["version"]:
            raise Conflict(f"version {self.base['version']} is not the newest any more")
        path = self.store.at(f"{self.store.path}/manifest/{version:08d}.json")
        try:
            out = self.store.fs.create(path, False)
        except Exception as e:  # of the file system's own kinds
            if "exist" in str(e).lower():
                raise Conflict(f"version {version} has another writer") from None
            raise
        out.write(bytearray(json.dumps(self.next, sort_keys=True).encode()))
        out.close()
        if self.store.versions()[-1] != version:
            raise Conflict(f"version {version} came too late")
        return version


def content_id(rows: DataFrame) -> str:
    """A name of a table's rows, whatever their order: a hash of their number and of sums of two row hashes."""
    cols = [F.col(c) for c in sorted(rows.columns)]
    row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    one = rows.select(F.sha2(row, 256).alias("s")).select(F.xxhash64("s").alias("a"), F.xxhash64("s", F.lit(7)).alias("b"))
    r = one.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{r[0]}:{r[1]}:{r[2]}").hex


def freeze(store: Store, tables: Mapping[str, T.StructType | str], references: Sequence[tuple[str, str, str, str]] = ()) -> str:
    """A snapshot of tables as they are now; its id follows from their rows, and the same rows give the same snapshot.

    references (table, column, target, key): a value of the column that no row of the target has as
    its key is an error, so a snapshot is closed. Nulls refer to nothing.
    """
    t = store.begin()
    seen = {n: t.read(n, s) for n, s in tables.items()}
    for name, column, target, key in references:
        lost = seen[name].select(F.col(column).alias("r")).where("r is not null").join(seen[target].select(F.col(key).alias("r")), "r", "left_anti").take(1)
        if lost:
            raise ValueError(f"{name}.{column} refers to {lost[0][0]}, which {target} lacks")
    ident = uuid.uuid5(uuid.NAMESPACE_OID, json.dumps({n: content_id(df) for n, df in sorted(seen.items())})).hex
    frozen = t.next["values"].setdefault("snapshots", {})
    if ident not in frozen:
        frozen[ident] = {n: t.next["tables"].get(n, {"folders": {}})["folders"] for n in tables}
        t.commit()
    return ident


def read_snapshot(store: Store, ident: str, name: str, schema: T.StructType | str) -> DataFrame:
    """A table of a snapshot, as it was when frozen; clean() keeps its files."""
    folders = store.manifest()["values"]["snapshots"][ident][name]
    return store._read({"tables": {name: {"folders": folders}}}, name, schema)


def publish(store: Store, name: str, rows: DataFrame, run: Column, unit: Column, key: str, revision: int | None = None) -> int:
    """Rows of a run's unit under an id of (run, unit, local key); publishing them again changes nothing. Returns the table's revision.

    With a revision, publishing fails with Conflict if the table has moved on since.
    """
    t = store.begin()
    if revision is not None:
        t.expect(name, revision)
    named = rows.withColumn("item_id", F.substring(F.sha2(F.concat_ws("\x1f", run.cast("string"), unit.cast("string"), F.col(key).cast("string")), 256), 1, 32))
    if name in t.base["tables"]:
        old = t.read(name, named.schema)
        changed = named.join(old.select(*named.columns), [named[c].eqNullSafe(old[c]) for c in named.columns], "left_anti")
    else:
        changed = named
    if changed.take(1):
        t.upsert(name, changed, ["item_id"])
        t.commit()
    return t.revision(name)


__all__ = ["Conflict", "Store", "Transaction", "content_id", "freeze", "publish", "read_snapshot"]
