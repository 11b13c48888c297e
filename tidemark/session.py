"""Session helpers: recommended settings, and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Broadcast joins are left to Spark: a side is broadcast only when
# its measured size is under spark.sql.autoBroadcastJoinThreshold, else the join shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_fallback_dir: list[str] = []
_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = getattr(spark, "sparkContext", None)
    if context is None or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) a temporary folder may stand in for it: executors on other
    machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if not _fallback_dir:
        _fallback_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _fallback_dir[0]


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For reduced tables that several branches of a plan need, and for loops.  The written table
    survives the loss of executors, and each branch reads only its own columns.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
