"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "mnemolake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on, and the package on its workers; on a cluster the submit-time
    conf wins."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_SCRATCH.get(context.applicationId)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    # Executors get the archive; workers next to the driver (stream drivers, local mode) the source folder.
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    context.environment["PYTHONPATH"] = os.pathsep.join([os.path.dirname(root), *filter(None, known)])
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "mnemolake")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(root), os.path.basename(root)))


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_dir(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables this application wrote between steps; call it when the results that read them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(scratch_dir(spark), spark.sparkContext.applicationId))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that lost executors do not replay the plan."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table several later steps read, once, to the shared folder; readers then prune its columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a slim table and count it: up to `limit` rows it may be broadcast, beyond that it is joined by shuffle."""
    table = materialize(df, "sized")
    return F.broadcast(table) if table.count() <= limit else table
