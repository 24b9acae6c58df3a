"""Index tables that change together, without being written anew.

A change writes the new rows alone, and the sources whose older rows they replace; a reader
merges both. What belongs to a version stands in a file of its own in the log, which is
created once and never overwritten: that is the commit, and of two writers that started
from one version the second is refused. Compaction writes tables anew under a version of
its own and drops what was replaced; files that no kept version names can be swept.

Defined cases: a table that a change doesn't name stays as it is, but for sources that it
replaces in others or that are gone, which leave every table; rows of a change with a null
source are appended, as they replace nothing; a failed write leaves the old version in
force; a table without rows reads as empty; columns that a later change adds read as null
in older rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of the version that wrote a row; a name that tables don't use.
_COMMIT = "_commit"


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    files, path = _files(spark, root)
    if not files.exists(path(f"{root}/log")):
        return []
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.listStatus(path(f"{root}/log")))


def current_version(spark: SparkSession, root: str) -> int:
    """The last version, or 0."""
    return max(versions(spark, root), default=0)


def _state(spark: SparkSession, root: str, version: int) -> dict:
    """What a version consists of: folders of each table, and of replaced sources."""
    if not version:
        return {"tables": {}, "replaced": []}
    return json.loads(spark.read.text(f"{root}/log/{version:012}.json", wholetext=True).first()["value"])


def _commit(spark: SparkSession, root: str, version: int, state: dict) -> int:
    files, path = _files(spark, root)
    target = path(f"{root}/log/{version:012}.json")
    try:
        out = files.create(target, False)
    except Exception as error:
        if files.exists(target):
            raise Conflict(f"version {version} of {root} is there already") from error
        raise
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    return version


def _read(spark: SparkSession, state: dict, name: str, source: str) -> DataFrame | None:
    """The rows of a table with the versions that wrote them."""
    folders = state["tables"].get(name)
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*folders)
    if state["replaced"]:
        later = spark.read.parquet(*state["replaced"]).groupBy(source).agg(F.max(_COMMIT).alias("_replaced"))
        rows = rows.join(later, source, "left").where(F.col("_replaced").isNull() | (F.col(_COMMIT) >= F.col("_replaced"))).drop("_replaced")
    return rows


def read_index(spark: SparkSession, root: str, name: str, version: int | None = None, source: str = "source") -> DataFrame | None:
    """A table of an index, as of its last or an earlier version; None if it isn't there."""
    state = _state(spark, root, current_version(spark, root) if version is None else version)
    rows = _read(spark, state, name, source)
    return None if rows is None else rows.drop(_COMMIT)


def write_index(spark: SparkSession, root: str, changes: dict[str, DataFrame], gone: DataFrame | None = None, source: str = "source", base: int | None = None) -> int:
    """Replaces the rows of sources in all tables of an index as one: what ``changes`` has
    comes in, older rows of its sources and of the sources ``gone`` leave every table. The
    work is that of the change. ``base`` is the version it was made from, the last one if
    not given; if there is a later one when it is done, ``Conflict`` is raised."""
    base = current_version(spark, root) if base is None else base
    state, version = _state(spark, root, base), base + 1
    part = f"{root}/data/{version:012}-{uuid.uuid4().hex[:12]}"
    touched = None
    for name, rows in changes.items():
        rows.withColumn(_COMMIT, F.lit(version).cast("long")).write.parquet(f"{part}/{name}")
        state["tables"].setdefault(name, []).append(f"{part}/{name}")
        # sources as they were written: a change that is read again may not be the same
        own = spark.read.parquet(f"{part}/{name}").select(source)
        touched = own if touched is None else touched.unionByName(own)
    if gone is not None:
        touched = gone.select(source) if touched is None else touched.unionByName(gone.select(source))
    if touched is not None and base:
        touched.where(F.col(source).isNotNull()).distinct().withColumn(_COMMIT, F.lit(version).cast("long")).write.parquet(f"{part}/_replaced")
        state["replaced"].append(f"{part}/_replaced")
    return _commit(spark, root, version, state)


def compact(spark: SparkSession, root: str, source: str = "source") -> int:
    """Writes every table anew as one folder, without replaced rows, as a version."""
    base = current_version(spark, root)
    state, part = _state(spark, root, base), f"{root}/data/{base + 1:012}-{uuid.uuid4().hex[:12]}"
    tables = {}
    for name in state["tables"]:
        _read(spark, state, name, source).write.parquet(f"{part}/{name}")
        tables[name] = [f"{part}/{name}"]
    return _commit(spark, root, base + 1, {"tables": tables, "replaced": []})


def sweep(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes all but the last ``keep`` versions and the folders that none of these names;
    gives the number of folders removed. Not while others write."""
    files, path = _files(spark, root)
    known = versions(spark, root)
    kept = [_state(spark, root, v) for v in known[-keep:]]
    named = {f for s in kept for f in [*s["replaced"], *(x for folders in s["tables"].values() for x in folders)]}
    for version in known[:-keep]:
        files.delete(path(f"{root}/log/{version:012}.json"), False)
    removed = 0
    for part in files.listStatus(path(f"{root}/data")) if files.exists(path(f"{root}/data")) else []:
        here = part.getPath().getName()
        for folder in files.listStatus(part.getPath()):
            if f"{root}/data/{here}/{folder.getPath().getName()}" not in named:
                files.delete(folder.getPath(), True)
                removed += 1
    return removed
