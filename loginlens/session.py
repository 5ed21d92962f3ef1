"""Session defaults and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for. Nothing breaks without them: they only
#: let joins reuse a (user, segment) partitioning and let AQE split hot users.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
#: Bytes of a login table's rows for one byte of its Parquet file.
FILE_TO_ROWS = 10.0


def build_session(app_name: str = "loginlens", master: str | None = None,
                  **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Functions of the package are pickled by name, so a worker must be able to
    import it wherever the job was started from.
    """
    context = spark.sparkContext
    if getattr(context, "_loginlens_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loginlens-code-"), "loginlens_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._loginlens_shipped = True
    return spark


def sized_as_rows(spark: SparkSession) -> None:
    """Let the planner take files for FILE_TO_ROWS times their size, unless the session says otherwise.

    Login tables shrink about so much in Parquet. Taken at the size of its file, a per-user
    table far above the broadcast threshold would be broadcast through the driver.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, str(FILE_TO_ROWS))


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside are shuffled, but those told by a hint to broadcast.

    Tables of one row per user grow with the input, and many of them under the broadcast
    threshold pass through the driver in one job after another; hints mark tables of bounded size.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from the session.

    A machine-local folder is made only in local mode, where driver and workers
    share the machine; a cluster session that names no folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        current = tempfile.mkdtemp(prefix="loginlens-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A new, empty path below the shared folder for one job's tables."""
    return f"{shared_dir(spark)}/loginlens-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    Lost executors then cost no recomputation. Unlike a checkpoint, a Parquet
    table is compressed, column-pruned on reading, and tells the optimizer its
    size, so joins against it are planned from a measured number.
    """
    path = run_dir(df.sparkSession, "cut")
    df.write.partitionBy(*partition_by).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._durable_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more, such as those of a finished round."""
    for stored in tables:
        spark = stored.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(stored._durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Hash by key into the session's full partition count, exempt from AQE merging.

    For stages whose cost lies in computing rather than in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
