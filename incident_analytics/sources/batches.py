"""Which batches of a table readers see.

A loaded table is a folder of ``batch=<id>`` folders and a list of the batches
that count, ``_batches/<version>``. A load or a stream's micro-batch writes its
rows (and its part of the daily summary, under ``_summary/batch=<id>``) without
touching what readers see, then publishes both in one step: it renames a new
version of the list into place. Until then the rows are in no list; a load that
dies leaves no trace but a folder that its next run overwrites. A batch already
in the list is not added again, so replaying one changes nothing. Two writers
that publish at the same time differ in the version's name: the later one finds
it taken and adds its batch to the newer list.

The list needs a store whose rename is atomic and does not overwrite (HDFS, a
local disk with one writer at a time).
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_batches"
SUMMARY = "_summary"
AUDIT = "_audit"      # of a batch: the counts of its cleaning
REJECTS = "_rejects"  # of a batch: its cleaned rows and the rejected ones
ATTEMPTS = 20


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _store(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/{LOG}") if n.isdigit())


def _read(spark: SparkSession, path: str, version: int) -> list[str]:
    fs, file = _store(spark, f"{path}/{LOG}/{version:012d}")
    stream = fs.open(file)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def live(spark: SparkSession, path: str) -> list[str] | None:
    """The folders' names of the batches readers see; None if the folder has no list."""
    versions = _versions(spark, path)
    return _read(spark, path, versions[-1]) if versions else None


def check_appendable(spark: SparkSession, path: str) -> None:
    """Raise if the folder holds rows but no list of batches: a list would hide them."""
    if live(spark, path) is None and any(not n.startswith(("_", ".", "batch=")) for n in _names(spark, path)):
        raise ValueError(f"{path} was not written in batches; a batch added to it would hide its rows")


def folder_of(spark: SparkSession, path: str, batch: str, replace: bool = False) -> str:
    """Name of the folder that a batch is written to. A batch that replaces the
    table while readers see it under the same name gets another one."""
    taken = set(live(spark, path) or [])
    name = f"batch={batch}"
    while replace and name in taken:
        name += "+"
    return name


def publish(spark: SparkSession, path: str, folder: str, replace: bool = False) -> bool:
    """Add the folder to the list, or make it the whole list. False if it was there already."""
    fs, log = _store(spark, f"{path}/{LOG}")
    fs.mkdirs(log)
    for _ in range(ATTEMPTS):
        versions = _versions(spark, path)
        before = _read(spark, path, versions[-1]) if versions else []
        if folder in before and not replace:
            return False
        after = [folder] if replace else [*before, folder]
        made = spark._jvm.org.apache.hadoop.fs.Path(log, f".{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        name = spark._jvm.org.apache.hadoop.fs.Path(log, f"{versions[-1] + 1 if versions else 0:012d}")
        if not fs.exists(name) and fs.rename(made, name):
            return True
        fs.delete(made, False)
    raise RuntimeError(f"{path}: other writers published {ATTEMPTS} times in between")


def remove_unlisted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of batches that no reader sees: of loads that died and of
    replaced batches. Not while a load or a reader of an older list runs."""
    listed = live(spark, path)
    gone = []
    for base in (path, *[f"{path}/{part}" for part in (SUMMARY, AUDIT, REJECTS)]) if listed is not None else ():
        for name in _names(spark, base):
            if name.startswith("batch=") and name not in listed:
                fs, folder = _store(spark, f"{base}/{name}")
                fs.delete(folder, True)
                gone.append(folder.toString())
    return gone


def read_batches(spark: SparkSession, path: str, schema, part: str = "") -> DataFrame:
    """Rows of the listed batches (with a ``batch`` column), or the plain table at
    ``path`` if it has no list. ``part``: a sub-folder, such as the summary's."""
    listed = live(spark, path)
    base = f"{path}/{part}" if part else path
    if listed is None:
        return spark.read.parquet(base)
    reader = spark.read.schema(schema).option("basePath", base)
    return reader.parquet(*[f"{base}/{name}" for name in listed])


def summary_folders(spark: SparkSession, path: str) -> set[str]:
    """Names of the batches whose part of the daily summary is written in full."""
    names = _names(spark, f"{path}/{SUMMARY}")
    return {n for n in names if "_SUCCESS" in _names(spark, f"{path}/{SUMMARY}/{n}")}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a batch."""
    fs, folder = _store(spark, path)
    fs.delete(folder, True)


def parts_of(spark: SparkSession, path: str, part: str) -> list[str]:
    """Paths of the listed batches' folders in a sub-folder that has one for only some of them."""
    names = set(_names(spark, f"{path}/{part}"))
    return [f"{path}/{part}/{name}" for name in live(spark, path) or [] if name in names]


def name_digest(names: list[str]) -> str:
    return hashlib.sha256("\n".join(names).encode()).hexdigest()[:16]


def export_id(spark: SparkSession, path: str) -> str:
    """Id of the files at ``path`` by their names, sizes and times of change: the
    same landed export has the same id in every run."""
    fs, folder = _store(spark, path)
    found = [folder] if fs.exists(folder) else [f.getPath() for f in fs.globStatus(folder) or []]
    lines = []
    for top in found:
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                lines.append(f"{f.getPath().getName()}\t{f.getLen()}\t{f.getModificationTime()}")
    return name_digest(sorted(lines))
