"""SparkSession factory and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "surgekit") -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE (coalesce + skew join), no UI.

    Master, partition count and driver memory are those of spark-submit unless the caller or the environment
    (SURGEKIT_MASTER, SURGEKIT_SHUFFLE_PARTITIONS, SURGEKIT_DRIVER_MEMORY) names others.
    """
    b = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("SURGEKIT_MASTER")
    if master:
        b = b.master(master)
    parts = shuffle_partitions or os.environ.get("SURGEKIT_SHUFFLE_PARTITIONS")
    if parts:
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    memory = os.environ.get("SURGEKIT_DRIVER_MEMORY")
    if memory:
        b = b.config("spark.driver.memory", memory)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session-level SQL settings operators rely on (idempotent, safe on any session).

    ``forceOptimizeSkewedJoin`` lets AQE split a hot key's join partition even where an aggregate above the join reuses its
    partitioning: it then adds the exchange that the aggregate needs, instead of leaving the hot key in one task."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


#: Bytes of Parquet input for each first partition of a shuffle; AQE joins small ones again.
SHUFFLE_INPUT_BYTES = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Lets shuffles begin with as many partitions as the input is worth, never fewer than the session's number, so that a task's
    share doesn't grow with the input."""
    n = input_bytes // SHUFFLE_INPUT_BYTES
    if n > int(spark.conf.get("spark.sql.shuffle.partitions", "200")):
        spark.conf.set(INITIAL_PARTITIONS, str(n))
    else:
        spark.conf.unset(INITIAL_PARTITIONS)


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of explicit number: the session's, or as ``size_shuffles`` set it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only a local session (tests) that names none gets a fresh scratch folder; on a cluster a missing setting is an
    error, since executors could not share a folder of the driver's machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="surgekit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Sends the package's source to the executors once per application, so that Python workers can import it wherever
    they run (what ``--py-files`` does)."""
    sc = spark.sparkContext
    if getattr(sc, "_surgekit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="surgekit-src-"), "surgekit_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._surgekit_shipped = True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whichever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate when the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint).

    Used where two branches of a plan must see the same physical partitioning (range partition ids,
    row ids): the checkpointed data is written once and both branches read it, and a lost executor
    re-reads it instead of re-sampling range bounds."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
