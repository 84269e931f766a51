"""Session helpers: building a local session for tests and resolving the
shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import logging
import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "softgrove") -> SparkSession:
    """A local session with the settings the tests and bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .config("spark.python.worker.reuse", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session
    that was not started with it on the path (``--py-files`` equivalent)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="softgrove-pkg-"), "softgrove.zip")
    with zipfile.ZipFile(out, "w") as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session with
    none configured gets a fresh scratch folder of its own."""
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if master.startswith("local"):
        d = tempfile.mkdtemp(prefix="softgrove-ckpt-", dir=os.environ.get("SOFTGROVE_SCRATCH", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir()
    return None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for files that several executors read. Raises where
    a cluster names none."""
    d = ensure_checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return d


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of an expensive intermediate table.

    A reliable checkpoint in the shared checkpoint folder survives the loss
    of executors; without a configured folder (never the case on a
    properly configured cluster) fall back to a replicated-to-disk cache,
    which Spark recomputes from the deterministic lineage when lost."""
    spark = df.sparkSession
    if ensure_checkpoint_dir(spark):
        return df.checkpoint(eager=eager)
    log.warning("spark.checkpoint.dir is not set; caching instead of checkpointing")
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    if eager:
        out.count()
    return out
