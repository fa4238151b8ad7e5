"""Session helpers.

The library never creates a session behind the caller's back: every operator takes
DataFrames. ``local_session`` is for tests and the bench; on a cluster the caller
brings its own session and these settings come from the cluster config.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tallyframe") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as
    is. Only when it is unset on a local master (a test session) is a private folder created;
    on any other master a machine-local folder would lose data, so this raises.
    """
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tallyframe-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    return conf_dir


def shared_work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tallyframe/{name}-{uuid.uuid4().hex[:12]}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet in a fresh shared folder and read back: later steps read
    the rows instead of repeating the plan, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python tasks this package, once an application (the executors need not have it installed)."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        if root.is_dir():  # else it runs from an archive that the application was given
            target = Path(tempfile.mkdtemp(prefix="tallyframe-code-")) / f"{root.name}.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
                for f in sorted(root.rglob("*.py")):
                    out.write(f, f.relative_to(root.parent))
            sc.addPyFile(str(target))
        _SHIPPED.add(sc.applicationId)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what stands directly in a folder; none where the folder is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file, in whatever stores the paths name."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme so tests can look at a written folder."""
    if uri.startswith("file:"):
        return uri[len("file:"):]
    return uri if os.path.isabs(uri) else os.path.abspath(uri)
