"""Session helpers: a local session for tests and the bench, and the shared
folder used to cut lineage (``spark.checkpoint.dir``)."""
from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
#: The JVM compiles no method of more bytecode than this: a longer one stays interpreted.
JIT_METHOD_BYTES = 8000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "vacanta") -> SparkSession:
    """A local session configured the way the library expects to be run.

    On a cluster the session comes from the platform; only the settings that
    matter for results (UTC, ANSI) must match there too.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there and it is used
    as is. Only when the setting is unset -- local runs and tests -- a fresh
    folder is created and registered on the session; on any other master an unset
    folder is an error.
    """
    with _LOCK:
        sc = spark.sparkContext
        conf = sc.getConf().get("spark.checkpoint.dir", None)
        if not conf:
            try:
                conf = spark.conf.get("spark.checkpoint.dir", None)
            except Exception:
                conf = None
        if conf:
            return conf.rstrip("/")
        current = sc.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vacanta-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir().rstrip("/")


@contextlib.contextmanager
def compiled_code(spark: SparkSession):
    """While it lasts, a plan whose fused code is too long for the JVM to compile runs operator
    by operator, each of them compiled. The caller's setting comes back after it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), JIT_METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop ``path`` when the application ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def folder_version(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, last change) of a file or folder, as its file system has them."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength(), fs.getFileStatus(jpath).getModificationTime()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder under the shared checkpoint folder, and a scan of
    it: the lineage ends there and the planner knows its bytes. The folder goes with the
    application."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/vacanta/{spark.sparkContext.applicationId}/steps/{uuid.uuid4().hex}/{name}"
    delete_on_exit(spark, path)
    with compiled_code(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
