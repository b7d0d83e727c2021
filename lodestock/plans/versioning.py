"""Versions of a catalog on a shared store: written, checked, published by one log entry, compared by hash trees, read pinned.

A version is a folder of Parquet tables and a manifest; neither changes once it is published. Entry n of the log names the active and
the previous version after the n-th publication. A publisher makes entry n + 1 for the n that it started from, and the store lets one
writer alone make it. A reader resolves an entry once, and every table it reads is of that entry's version.

Each table is stored in the order of its rows' leaf, a hash of the key; the manifest keeps the sum of all rows' digests, the table
`tree` that of each leaf. Equal sums of two versions need no reading; else only the rows of leaves that differ are read, which the scan
finds by the leaf's minima and maxima in the files.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import build_identity
from ..sources.store import BusyError, Lease, Store

T = TypeVar("T")
#: Leaves of a table's tree, whatever its size.
LEAVES = 4096
LEAF, DIGEST, KEY_DIGEST = "__leaf", "__digest", "__key"
SUMS = ("rows", "digest", "keys")


class GateError(ValueError):
    """A build's checks found errors; nothing was published."""


class DataChangedError(RuntimeError):
    """Another version was published while a result was being made."""


class LineageError(ValueError):
    """A version does not descend from the one that was named."""


def _number(hexed: Column, at: int) -> Column:
    return F.conv(F.substring(hexed, at, 15), 16, 10).cast("decimal(38,0)")


def with_leaves(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows plus their leaf, and digests of the row and of its key: sixty bits of a hash, which add up regardless of order."""
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}))
    named = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key)]), {"ignoreNullFields": "false"}))
    return rows.withColumns({LEAF: F.conv(F.substring(named, 28, 3), 16, 10).cast("int") % LEAVES, DIGEST: _number(whole, 1), KEY_DIGEST: _number(named, 1)})


def leaf_sums(leaved: DataFrame) -> DataFrame:
    """(leaf, rows, digest, keys), at most LEAVES rows."""
    return leaved.groupBy(F.col(LEAF).alias("leaf")).agg(F.count("*").alias("rows"), F.sum(DIGEST).cast("string").alias("digest"), F.sum(KEY_DIGEST).cast("string").alias("keys"))


class Snapshot:
    """One published state: all tables read through it are of one version."""

    def __init__(self, versions: Versions, number: int, version: str):
        self.versions, self.number, self.version = versions, number, version

    def table(self, name: str) -> DataFrame:
        return self.versions.table(self.version, name)

    def check(self) -> None:
        """An error if another version has been published since."""
        if self.versions.store.newest("log")[0] != self.number:
            raise DataChangedError(f"a version was published after {self.version}")


class Versions:
    """Versions of named tables under a root that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._listed: dict[tuple[str, str], DataFrame] = {}

    # -- states -------------------------------------------------------------------------------------------------------

    def state(self) -> dict:
        _, entry = self.store.newest("log")
        return {k: entry and entry[k] for k in ("active", "previous")}

    def manifest(self, version: str) -> dict:
        return self.store.read(f"{version}/manifest.json")

    def snapshot(self) -> Snapshot:
        number, entry = self.store.newest("log")
        if not entry:
            raise RuntimeError("nothing has been published")
        return Snapshot(self, number, entry["active"])

    def pinned(self, plan: Callable[[Snapshot], DataFrame], act: Callable[[DataFrame], T], tries: int = 2) -> T:
        """The action's result on a plan over one version, which was the active one from before the plan was made until the action ended.

        A version published meanwhile discards the result, and plan and action are tried again; after `tries`, DataChangedError.
        """
        for _ in range(tries):
            snap = self.snapshot()
            out = act(plan(snap))
            with contextlib.suppress(DataChangedError):
                snap.check()
                return out
        raise DataChangedError(f"versions kept being published in {tries} tries")

    @contextlib.contextmanager
    def writer(self, seconds: float = 60.0):
        """The only writer, or BusyError at once."""
        with Lease(self.store, seconds=seconds).held() as lease:
            yield lease

    def _publish(self, lease: Lease, number: int, active: str, previous: str | None) -> None:
        lease.check()
        if not self.store.append("log", number + 1, {"active": active, "previous": previous, "fence": lease.number, "at": datetime.now(UTC).isoformat()}):
            raise BusyError(f"another writer published while {active} was made")

    # -- tables -------------------------------------------------------------------------------------------------------

    def _stored(self, version: str, name: str, schema: StructType | None = None) -> DataFrame:
        if (version, name) not in self._listed:  # a published table never changes: its files are listed once
            schema = schema or StructType.fromJson(self.manifest(version)["tables"][name]["schema"])
            self._listed[version, name] = self.spark.read.schema(schema).parquet(f"{self.store.root}/{version}/{name}")
        return self._listed[version, name]

    def table(self, version: str, name: str) -> DataFrame:
        return self._stored(version, name).drop(LEAF, DIGEST, KEY_DIGEST)

    def read(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def _write(self, version: str, tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], partitions: dict[str, str]) -> dict[str, dict]:
        sums = {}
        for name, df in tables.items():
            path = f"{self.store.root}/{version}/{name}"
            if name in partitions:  # a table of folders, of its own order; it has no tree
                df.write.partitionBy(partitions[name]).parquet(path)
                sums[name] = {"rows": self._stored(version, name, df.schema).count(), "key": None, "schema": df.schema.jsonValue()}
                continue
            key = keys.get(name) or (df.columns[0],)
            leaved = with_leaves(df, key)
            leaved.repartitionByRange(LEAF, DIGEST).sortWithinPartitions(LEAF).write.parquet(path)
            leaf_sums(self._stored(version, name, leaved.schema)).coalesce(1).write.parquet(f"{self.store.root}/{version}/tree/{name}")
            sums[name] = self._total(version, name) | {"key": list(key), "schema": leaved.schema.jsonValue()}
        return sums

    def _tree(self, version: str, name: str) -> DataFrame:
        return self.spark.read.schema("leaf int, rows long, digest string, keys string").parquet(f"{self.store.root}/{version}/tree/{name}")

    def _total(self, version: str, name: str) -> dict:
        r = self._tree(version, name).agg(F.coalesce(F.sum("rows"), F.lit(0)), *[F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string") for c in SUMS[1:]]).first()
        return dict(zip(SUMS, r))

    def current(self, identity: dict) -> Snapshot | None:
        """The active version, if it was made from `identity`."""
        if not self.store.newest("log")[0]:
            return None
        now = self.snapshot()
        return now if self.manifest(now.version)["identity"] == build_identity(identity) else None

    # -- writing ------------------------------------------------------------------------------------------------------

    def rebuild(self, identity: dict, tables: dict[str, DataFrame], checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None, *, keys: dict[str, tuple[str, ...]] | None = None, partitions: dict[str, str] | None = None, base: str | None = None) -> str:
        """Writes, checks and publishes a version; the active one's name if its identity is the same. A check gives the rows that forbid publishing.

        keys: the columns that name a table's rows (else its first). partitions: tables written in folders by a column. base: the version that this one changes.
        """
        identity_key = build_identity(identity)
        with self.writer() as lease:
            number, entry = self.store.newest("log")
            active = entry and entry["active"]
            if active and self.manifest(active)["identity"] == identity_key:
                return active
            version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{identity_key[:12]}-{uuid.uuid4().hex[:6]}"
            try:
                sums = self._write(version, tables, keys or {}, partitions or {})
                written = {n: self.table(version, n) for n in tables}
                for name, check in (checks or {}).items():
                    if bad := check(written).limit(20).collect():
                        raise GateError(f"{name}: {[tuple(r) for r in bad]}")
                ancestry = None if base is None else {"version": base, "tables": self.manifest(base)["tables"]}
                manifest = {"version": version, "identity": identity_key, "fields": identity, "counts": {n: t["rows"] for n, t in sums.items()}, "tables": sums, "base": ancestry, "built_at": datetime.now(UTC).isoformat()}
                self.store.publish(f"{version}/manifest.json", manifest)
                self._publish(lease, number, version, active)
            except BaseException:
                self.store.delete(version)
                raise
            return version

    def rollback(self) -> str:
        """Swaps the active and the previous version."""
        with self.writer() as lease:
            number, entry = self.store.newest("log")
            if not entry or not entry["previous"]:
                raise RuntimeError("there is no previous version")
            self.verify(entry["previous"], rows=False)
            self._publish(lease, number, entry["previous"], entry["active"])
            return entry["previous"]

    def purge(self) -> list[str]:
        """Deletes the versions that are neither active, nor previous, nor an ancestor of these, and gives their names. Readers that pinned one of them fail."""
        with self.writer():
            _, entry = self.store.newest("log")
            kept = {a for v in (entry["active"], entry["previous"]) if v for a in self.lineage(v)} if entry else set()
            gone = [n for n in self.store.names("") if self.store.exists(f"{n}/manifest.json") and n not in kept]
            for name in gone:
                self.store.delete(name)
            return gone

    # -- checks and comparison ----------------------------------------------------------------------------------------

    def lineage(self, version: str) -> list[str]:
        """A version and its ancestors, the newest first. An ancestor whose tables are not those that its descendant was made from is an error."""
        out = [version]
        while base := self.manifest(out[-1])["base"]:
            if not self.store.exists(f"{base['version']}/manifest.json") or self.manifest(base["version"])["tables"] != base["tables"]:
                raise LineageError(f"{out[-1]} was made from another {base['version']}")
            out.append(base["version"])
        return out

    def require_base(self, version: str, base: str) -> None:
        if base not in self.lineage(version):
            raise LineageError(f"{version} belongs to a different baseline than {base}")

    def verify(self, version: str | None = None, rows: bool = True) -> None:
        """A version against its manifest: its files, the sums of its trees and, with `rows`, each leaf's rows themselves; the error names the leaves."""
        version = version or self.snapshot().version
        for name, told in self.manifest(version)["tables"].items():
            if not self.store.exists(f"{version}/{name}/_SUCCESS"):
                raise RuntimeError(f"{version} lacks {name}")
            if not told["key"]:
                if rows and self._stored(version, name).count() != told["rows"]:
                    raise RuntimeError(f"{version}: {name} differs from its manifest")
                continue
            if self._total(version, name) != {k: told[k] for k in SUMS}:
                raise RuntimeError(f"{version}: the tree of {name} differs from its manifest")
            if rows:
                now = leaf_sums(with_leaves(self.table(version, name), tuple(told["key"])))
                if bad := self._unequal(now, self._tree(version, name), ("rows", "digest", "keys")):
                    raise RuntimeError(f"{version}: {name} differs from its manifest in leaves {bad[:20]}")

    def _unequal(self, a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> list[int]:
        x, y = (F.struct(*[F.col(f"{t}.{c}") for c in columns]) for t in ("a", "b"))
        met = a.alias("a").join(b.alias("b"), F.col("a.leaf") == F.col("b.leaf"), "full_outer")
        return sorted(r[0] for r in met.where(~x.eqNullSafe(y)).select(F.coalesce("a.leaf", "b.leaf")).collect())  # at most LEAVES

    def differing_leaves(self, old: str, new: str, name: str) -> list[int]:
        """Leaves whose rows differ in two versions, by their trees; where the manifests' sums agree not even these are read."""
        a, b = ({k: self.manifest(v)["tables"][name][k] for k in (*SUMS, "key")} for v in (old, new))
        if a == b:
            return []
        if a["key"] != b["key"]:
            raise ValueError(f"{name} has other keys in {new}")
        return self._unequal(self._tree(old, name), self._tree(new, name), ("rows", "digest"))

    def _in(self, version: str, name: str, leaves: list[int]) -> DataFrame:
        return self._stored(version, name).where(F.col(LEAF).isin(leaves) if leaves else F.lit(False))

    def differences(self, old: str, new: str, name: str) -> DataFrame:
        """(key columns, change): added, removed or changed rows of a table. Reads the rows of differing leaves alone."""
        key, leaves = self.manifest(new)["tables"][name]["key"], self.differing_leaves(old, new, name)
        of = lambda version, as_: self._in(version, name, leaves).groupBy(*key).agg(F.struct(F.count("*"), F.sum(DIGEST)).alias(as_))
        a, b = of(old, "was"), of(new, "now")
        met = a.join(b, [a[k].eqNullSafe(b[k]) for k in key], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        return met.select(*[F.when(F.col("now").isNull(), a[k]).otherwise(b[k]).alias(k) for k in key], change.alias("change"))

    def unmatched_keys(self, version: str, left: str, right: str) -> DataFrame:
        """(key columns of `left`, only_in): keys that one of two tables of a version has and the other lacks, such as vectors of no document.

        Leaves whose keys add up alike are not read. Keys of either table that occur more often than in the other count as unmatched.
        """
        told = self.manifest(version)["tables"]
        names = told[left]["key"]
        leaves = [] if all(told[left][c] == told[right][c] for c in ("rows", "keys")) else self._unequal(self._tree(version, left), self._tree(version, right), ("rows", "keys"))
        of = lambda name, as_: self._in(version, name, leaves).groupBy(*[F.col(k).cast("string").alias(n) for k, n in zip(told[name]["key"], names)]).agg(F.count("*").alias(as_))
        a, b = of(left, "l"), of(right, "r")
        met = a.join(b, [a[k].eqNullSafe(b[k]) for k in names], "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
        more = F.coalesce("l", F.lit(0)) > F.coalesce("r", F.lit(0))
        return met.select(*[F.coalesce(a[k], b[k]).alias(k) for k in names], F.when(more, left).otherwise(right).alias("only_in"))
