"""Sessions, tables, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_factloom_shipped"


def session(app: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once a context, so that Python workers can import them."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom_modules.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages, which all executors reach: the one that the session names in
    spark.checkpoint.dir. Without one a local session gets a temporary folder; a cluster is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors reach in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        atexit.register(_remove_late, spark, context.getCheckpointDir())  # a folder of this application's own within the named one
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there. What is written goes when nothing refers to it any more, where the
    application has switched that on (spark.cleaner.referenceTracking.cleanCheckpoints, as session() does)."""
    ship(df.sparkSession)
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which is removed when Python ends, if nobody removed it before."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_late, spark, path)
    return path


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except (AttributeError, OSError, Py4JError, Py4JNetworkError):  # the session has ended before
        pass


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to a folder that all executors reach, and go on from there; survives the loss of executors."""
    ship(df.sparkSession)
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
