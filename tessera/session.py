"""A local or cluster session with the settings the library expects."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """UTC and adaptive execution; anything in conf wins (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while; what it was before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once a context; workers need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "tessera_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._tessera_shipped = True
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may go without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: numbers given to rows stay theirs, and lineage ends there."""
    path = f"{shared_root(df.sparkSession)}/library/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
