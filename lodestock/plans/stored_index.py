"""Indexes that queries keep on the shared folder: built once for a state of their source, read by every later search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.inverted import Inverted, index_tables
from ..sources.store import BusyError, shared_folder, short_hash, signature
from .versioning import Snapshot, Versions

#: Goes up when the form of stored tables or of tokens changes, so that indexes of before are made anew.
LAYOUT = 3


def kept(spark: SparkSession, name: str, source: str, rules: dict, build: Callable[[], dict[str, DataFrame]], partitions: dict[str, str] | None = None) -> Snapshot:
    """A version of the tables of `build`, made only if the source's files or the rules have changed since the last one.

    Of several processes one builds; one that comes meanwhile builds a version beside, under a root of its own.
    """
    identity = {"files": signature(spark, source), "rules": rules, "layout": LAYOUT}
    root = f"{shared_folder(spark)}/index/{name}-{short_hash(source)}"
    if now := Versions(spark, root).current(identity):
        return now
    try:
        Versions(spark, root).rebuild(identity, build(), partitions=partitions)
    except BusyError:
        root = f"{root}-{uuid.uuid4().hex}"
        Versions(spark, root).rebuild(identity, build(), partitions=partitions)
    return Versions(spark, root).snapshot()


def inverted(now: Snapshot) -> Inverted:
    return Inverted(now.table("postings"), now.table("lengths"))


def kept_index(spark: SparkSession, name: str, source: str, docs: DataFrame, key: str, fields: dict[str, Column], rules: dict | None = None) -> Inverted:
    """The index of a table's text columns. rules: what the fields' tokens depend on besides the files."""
    return inverted(kept(spark, name, source, {"fields": sorted(fields), "key": key, **(rules or {})}, lambda: index_tables(docs, key, fields), {"postings": "bucket"}))
