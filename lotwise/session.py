"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the operators assume.  UTC keeps text stamps repeatable; ANSI stays
# on (Spark's default) so every lenient parse is spelled ``try_*``.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a key that an object repeats the last value counts, as in other JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Java compiles no longer method than this; longer ones (the page texts) are interpreted, or cut up by Spark.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lotwise",
                  extra_conf: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LOTWISE_DRIVER_MEMORY", "8g"))
    )
    for k, v in {**SESSION_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the session settings the operators rely on (idempotent)."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    cluster, and it must be set there: executors cannot share a folder that
    the driver makes for itself.  Only a session in one process (``local``
    masters, as in tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lotwise-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers as a zip file, for
    clusters whose workers do not have it on their search path.  Done once a
    session."""
    sc = spark.sparkContext
    if getattr(sc, "_lotwise_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="lotwise-package-"), "lotwise-package")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    sc._lotwise_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder."""
    return f"{shared_dir(spark)}/lotwise-{name}-{uuid.uuid4().hex[:12]}"


#: Folders that a task may write to side by side.
MAX_FOLDERS = 16


@contextmanager
def _held(spark: SparkSession, name: str, value):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def few_folders(spark: SparkSession):
    """Writes partitioned into at most ``MAX_FOLDERS`` folders keep a file open for each, instead of sorting (and
    spilling) a task's rows by folder; with more of them Spark sorts the rest."""
    return _held(spark, "spark.sql.maxConcurrentOutputFileWriters", MAX_FOLDERS)


def freed_shuffles(spark: SparkSession):
    """The shuffle files of a write are deleted when it ends, not when the driver happens to collect its garbage: the
    next step finds the disk free."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bytes of text that a task reads where it sorts what it has read.
MAX_SORTED_SPLIT = 32 << 20


def small_splits(spark: SparkSession):
    """Files are read in pieces of at most ``MAX_SORTED_SPLIT`` bytes, whose rows a task sorts without spilling."""
    name = "spark.sql.files.maxPartitionBytes"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return _held(spark, name, str(min(now, MAX_SORTED_SPLIT)))
