"""Session settings that every plan in this package assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "quernstone", **conf: str) -> SparkSession:
    """A session with AQE on and the UTC time zone; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
