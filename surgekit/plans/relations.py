"""Shared written relations: what several queries of one application read is computed once.

A relation is keyed by its name, its source folder, the state of the source's tables (path, length and modification time of every
file) and the queries' as-of date. It is written to the shared checkpoint folder, where a lost executor rereads it; other
applications don't see it, and it goes when the application ends. A changed table gives another key, so nothing stale is read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_at_exit, path_exists, scratch_path
from ..sources import fixtures as fx

SOURCES = ("orders", "lineitem", "customer", "nation", "events")
_WRITTEN: dict[tuple[str, ...], str] = {}
_PLANNED: dict[tuple[str, ...], DataFrame] = {}


def source_version(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = SOURCES) -> str:
    """A digest of the files of the tables, from the file system's own listing."""
    jvm = spark._jvm
    seen = []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            seen += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(path)]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def source_bytes(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = (*SOURCES, "supplier")) -> int:
    """The bytes of the tables, from the file system's own listing."""
    jvm = spark._jvm
    found = 0
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
    return found


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The relation ``name`` of a source folder, built and written by the first who asks for it."""
    key = (spark.sparkContext.applicationId, name, sf_dir, source_version(spark, sf_dir), fx.AS_OF)
    path = _WRITTEN.get(key)
    if path is None or not path_exists(spark, f"{path}/_SUCCESS"):
        path = f"{scratch_path(spark, 'relation-' + name)}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        delete_at_exit(spark, path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def planned(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A frame over written relations whose planning takes jobs of its own: planned once, not written."""
    key = (spark.sparkContext.applicationId, name, sf_dir, source_version(spark, sf_dir), fx.AS_OF)
    if key not in _PLANNED:
        _PLANNED[key] = build()
    return _PLANNED[key]


def forget(spark: SparkSession) -> None:
    """Drops the application's relations from the registry; their files go when it ends."""
    for known in (_WRITTEN, _PLANNED):
        for key in [k for k in known if k[0] == spark.sparkContext.applicationId]:
            del known[key]
