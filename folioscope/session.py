"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session without one (a test) gets a folder of its own.

    On a cluster a folder of one machine would not do, so there a missing setting is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscope-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as a table in the shared folder, and read it from there.

    Used where several actions or branches read the same expensive result; the copy outlives lost executors.  A
    checkpoint would compute the last stage twice, once to count and once to write.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if any(os.path.basename(path).startswith("folioscope-") for path in context._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="folioscope-package-")
    archive = os.path.join(folder, f"folioscope-{os.getpid()}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for at, folders, files in os.walk(os.path.join(root, "folioscope")):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for file in files:
                if file.endswith(".py"):
                    out.write(os.path.join(at, file), os.path.relpath(os.path.join(at, file), root))
    context.addPyFile(archive)
