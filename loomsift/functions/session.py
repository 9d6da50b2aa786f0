"""Session helpers: a local session for tests and the shared folder for cut lineage."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, name: str = "loomsift") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session in one process may go without it; it then gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomsift-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder name below the shared folder; Spark creates it on writing."""
    return os.path.join(shared_folder(spark), f"{purpose}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` reliably and forget how it was computed."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table_of(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: computed once, and of a size that Spark knows when it plans a join."""
    folder = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fence(df: DataFrame, *costly: str) -> DataFrame:
    """Pass the costly columns through a one-element generator.

    Catalyst pushes a filter on a computed column below the projection by repeating the expression,
    which for a chain of dependent projections multiplies the work. Filters on generated columns
    stay where they are; those on the other columns are pushed down as usual.
    """
    kept = [c for c in df.columns if c not in costly]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*costly))))
