"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Of scratch tables: texts and hashes take less disk than in the default codec of the session.
COMPRESSION = "zstd"
_SHIPPED: set[str] = set()
# Scratch base of local sessions without spark.checkpoint.dir; goes when the interpreter ends.
_LOCAL_BASE: list[tempfile.TemporaryDirectory] = []


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rulewell-")) / "rulewell.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "rulewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def _scratch_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _LOCAL_BASE:
            _LOCAL_BASE.append(tempfile.TemporaryDirectory(prefix="rulewell-", ignore_cleanup_errors=True))
        base = _LOCAL_BASE[0].name
    return f"{base.rstrip('/')}/rulewell-{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared directory named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where driver and executors share a disk.
    """
    return f"{_scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Remove all that this application has written as scratch; whether there was anything.

    Results read scratch tables when they are computed, so this belongs after the last of them has been
    stored. Other applications' folders under the same directory stay.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_scratch_base(spark))
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared scratch folder.

    For small results of expensive plans that several later steps read: the plan runs once, and a
    lost executor costs a re-read instead of a re-run.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
