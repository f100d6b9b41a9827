"""Optimistic commits: the state of a table is the newest of its numbered files, and each number is taken once.

A writer reads the state, writes its data to a folder of its own and publishes the next number. If another writer
was first, it reads the new state and tries again, or gives up where the other one changed what it has read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Numbers kept for readers that started earlier; folders that only older ones name are deleted.
KEPT = 2


class ConcurrentCommit(RuntimeError):
    """Another writer changed what this one has read."""


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, base: str) -> list[int]:
    files, folder = _files(spark, f"{base}/log")
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def read(spark: SparkSession, base: str, version: int) -> dict:
    files, path = _files(spark, f"{base}/log/{version}.json")
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, base: str, before: int | None = None) -> tuple[int, dict | None]:
    """The newest number (below ``before``) and its state; -1 and None if there is none."""
    known = [v for v in versions(spark, base) if before is None or v < before]
    return (known[-1], read(spark, base, known[-1])) if known else (-1, None)


def publish(spark: SparkSession, base: str, version: int, state: dict) -> bool:
    """Make ``state`` the table's state number ``version``; False if that number is taken.

    The file is written under another name and renamed without overwriting, so readers see it whole or not at all and
    only one writer succeeds, on file systems whose rename is atomic (HDFS, local disks).
    """
    files, path = _files(spark, f"{base}/log/{version}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{version}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(json.dumps(state).encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(path), none)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    return True


def folders(state: dict) -> set[str]:
    """Every folder below the table that a state names, under the key ``folder`` at any depth."""
    found = set()
    for key, value in state.items():
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict):
                found |= folders(item)
            elif key == "folder" and item:
                found.add(item)
    return found


def drop_folder(spark: SparkSession, base: str, folder: str) -> None:
    files, path = _files(spark, f"{base}/{folder}")
    files.delete(path, True)


def prune(spark: SparkSession, base: str, kept: int = KEPT) -> None:
    """Delete old numbers, and the folders that only they name; folders of running writers are in no state yet."""
    known = versions(spark, base)
    old, new = known[:-kept], known[-kept:]
    if not old:
        return
    used = set().union(*(folders(read(spark, base, v)) for v in new))
    for version in old:
        for folder in folders(read(spark, base, version)) - used:
            drop_folder(spark, base, folder)
        drop_folder(spark, base, f"log/{version}.json")
