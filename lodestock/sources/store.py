"""Small files on any store that Spark reaches: whole reads, names that only one writer can make, and leases that expire.

Nothing here goes through local paths: the driver uses Hadoop's FileSystem, so a root may be `hdfs://`, `viewfs://` or `file:`.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..functions.scalars import canonical_json

_local_dir: str | None = None


class BusyError(RuntimeError):
    """Another writer holds the lease, or made the name first."""


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which every executor sees; a temporary folder of this process only for a local master without it."""
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/lodestock-plans"
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lodestock-")
    return f"file://{_local_dir}"


class Store:
    """Small JSON files under a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._jvm, self._conf = spark, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder; none if it does not exist. Names with a dot before them are not finished."""
        if not self.exists(folder):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(folder)) if not (n := s.getPath().getName()).startswith("."))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def publish(self, name: str, value: object) -> bool:
        """Makes the file `name` with all of its content at once. False if it exists: of several writers one alone gets True.

        A finished hidden file takes the name by a rename that never replaces (a hard link on a local disk, whose rename would).
        """
        folder, _, last = name.rpartition("/")
        hidden = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(canonical_json(value).encode())
            if out.hasCapability("hsync"):
                out.hsync()
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                at = self._jvm.java.nio.file.Paths.get
                self._jvm.java.nio.file.Files.createLink(at(self._path(name).toUri()), at(hidden.toUri()))
            else:
                never = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(hidden, self._path(name), never)
                return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(hidden, False)
        return True

    def newest(self, folder: str) -> tuple[int, dict | None]:
        """Number and content of the last file of a numbered log; 0 and None if it has none."""
        names = self.names(folder)
        return (int(names[-1].split(".")[0]), self.read(f"{folder}/{names[-1]}")) if names else (0, None)

    def append(self, folder: str, number: int, value: object) -> bool:
        """Makes entry `number` of a log; False if another writer has."""
        return self.publish(f"{folder}/{number:020}.json", value)


def signature(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of change of every file at a path: what tells one state of a source from another."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        s = files.next()
        out.append([s.getPath().toString(), s.getLen(), s.getModificationTime()])
    return sorted(out)


def short_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]


class Lease:
    """The right to write, for one holder among all hosts, until it is given back or runs out.

    Each state of the lease is the next entry of a log, which one writer alone can append. The number of the holder's entry is its
    fence: who publishes checks that no later one exists. Clocks of hosts need to agree to within the lease's length only for
    waiting no longer than needed; two that both believe to hold it are told apart by the log they publish to.
    """

    def __init__(self, store: Store, folder: str = "lease", seconds: float = 60.0, clock: Callable[[], float] = time.time):
        self.store, self.folder, self.seconds, self.clock = store, folder, seconds, clock
        self.owner, self.number = uuid.uuid4().hex, 0

    def _next(self, after: int, until: float) -> None:
        if not self.store.append(self.folder, after + 1, {"owner": self.owner, "until": until}):
            raise BusyError("another writer is at work")
        self.number = after + 1

    def acquire(self) -> Lease:
        number, last = self.store.newest(self.folder)
        if last and last["until"] > self.clock():
            raise BusyError("another writer is at work")
        self._next(number, self.clock() + self.seconds)
        for old in self.store.names(self.folder)[:-8]:
            self.store.delete(f"{self.folder}/{old}")
        return self

    def renew(self) -> None:
        """A later end; an error if another has taken the lease since."""
        self.check()
        self._next(self.number, self.clock() + self.seconds)

    def check(self) -> None:
        number, last = self.store.newest(self.folder)
        if number != self.number or last["owner"] != self.owner:
            raise BusyError("the lease ran out and another writer took it")

    def release(self) -> None:
        with contextlib.suppress(BusyError):
            self.check()
            self._next(self.number, 0.0)

    @contextlib.contextmanager
    def held(self):
        """The lease while the block runs, renewed at each third of its time."""
        self.acquire()
        over = threading.Event()

        def renewing() -> None:
            while not over.wait(self.seconds / 3):
                try:
                    self.renew()
                except BusyError:
                    return

        renewer = threading.Thread(target=renewing, daemon=True)
        renewer.start()
        try:
            yield self
        finally:
            over.set()
            renewer.join()
            self.release()
