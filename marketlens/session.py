"""SparkSession construction and cluster-level settings.

On a cluster the session comes from the launcher and already carries its
settings; ``get_session`` only fills in values that are unset, so a shared
``spark.checkpoint.dir`` named by the cluster is never overridden.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import sys
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Row, SparkSession

# Settings every analysis relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is small), coalesces tiny shuffle
# partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "marketlens", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local test
    session without one gets a scratch folder of its own."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHARED: dict[tuple, str] = {}
DENSE = "zstd"  # of tables written once and read by many scans


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def source_version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(modification time, bytes, files) of an input folder or file: three
    calls to its file system, whatever the number of files. Files added to or
    removed from the folder, or replaced by others, change it."""
    system, p = _hadoop_path(spark, path)
    summary = system.getContentSummary(p)
    return system.getFileStatus(p).getModificationTime(), summary.getLength(), summary.getFileCount()


def shared_table(spark: SparkSession, key: str, build, inputs: Sequence[str] = ()) -> DataFrame:
    """A cleaned intermediate that many reports read (cleaned ticket orders,
    cleaned startups, cleaned venues) is computed once per application and
    written as parquet under the shared ``spark.checkpoint.dir``; every
    consumer then scans it with column pruning and filter pushdown instead
    of re-running the joins, dedupes and percentile caps. The written table
    cuts the lineage, so a lost executor re-reads files rather than
    recomputing the cleaning. ``inputs`` are the paths it is built from: when
    one of them has changed the table is built again.

    ``build`` returns a frame, or a frame and metrics (aggregate columns) that
    are observed while it is written and stored beside it, for
    ``shared_metrics``."""
    path, fresh = _shared_path(spark, key, inputs)
    if fresh:
        built = build()
        if isinstance(built, tuple):
            seen = Observation()
            built[0].observe(seen, *built[1]).write.mode("overwrite").parquet(path, compression=DENSE)
            spark.createDataFrame([Row(**seen.get)]).coalesce(1).write.mode("overwrite").parquet(f"{path}.metrics")
        else:
            built.write.mode("overwrite").parquet(path, compression=DENSE)
        _SHARED[_shared_memo(spark, key, inputs)] = path
    return spark.read.parquet(path)


def shared_metrics(spark: SparkSession, key: str, build, inputs: Sequence[str] = ()) -> DataFrame:
    """The one row of metrics observed when the shared table was written."""
    shared_table(spark, key, build, inputs)
    return spark.read.parquet(f"{_shared_path(spark, key, inputs)[0]}.metrics")


def _shared_memo(spark: SparkSession, key: str, inputs: Sequence[str]) -> tuple:
    return (spark.sparkContext.applicationId, key, *(source_version(spark, p) for p in inputs))


def _shared_path(spark: SparkSession, key: str, inputs: Sequence[str]) -> tuple[str, bool]:
    """Where the table of the present inputs is, and whether it is to be built."""
    memo = _shared_memo(spark, key, inputs)
    if memo in _SHARED:
        return _SHARED[memo], False
    safe = "".join(ch if ch.isalnum() or ch in "-_." else "_" for ch in key)
    version = hashlib.sha256(repr(memo).encode()).hexdigest()[:16]
    return f"{_scratch(spark, 'marketlens-shared')}/{safe}-{version}", True


def _scratch(spark: SparkSession, kind: str) -> str:
    """The application's folder of one kind under the checkpoint folder. It is
    removed when the Python process ends with the session still open."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # stopped: the folder stays
        try:
            system, p = _hadoop_path(spark, folder)
            system.delete(p, True)
        except Exception as e:  # noqa: BLE001 - the JVM may be gone already
            print(f"scratch folder {folder} stays: {type(e).__name__}", file=sys.stderr)


def write_through(df: DataFrame, tag: str = "tmp", compression: str | None = None) -> DataFrame:
    """Compute ``df`` once, write it as parquet under the shared checkpoint
    folder and return a frame reading it back: the lineage is cut (a lost
    executor re-reads the files) at the cost of one computation, where
    ``checkpoint()`` computes twice without a cache. ``compression`` is the
    codec of the files, by default the session's."""
    spark = df.sparkSession
    path = f"{_scratch(spark, 'marketlens-tmp')}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)
