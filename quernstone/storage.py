"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder. Where neither is set, a session on one machine gets a temporary
    folder of its own; on a cluster that would not be shared, so the call is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quernstone-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


_LIVE: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, root in _LIVE:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, root)


@contextlib.contextmanager
def intermediates():
    """Removes what operators stored inside the block. Their results are lazy, so they
    have to be written or read before it ends."""
    start = len(_LIVE)
    yield
    for spark, root in _LIVE[start:]:
        _delete(spark, root)
    del _LIVE[start:]


class Scratch:
    """Intermediate tables in the shared folder. A saved table cuts the lineage, so a
    lost executor costs only the tasks of the current step. What is left of them goes
    with ``intermediates`` or when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        _LIVE.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
