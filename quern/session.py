"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the operators expect: UTC, AQE, few shuffle partitions."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quern")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests on one
    machine) a temporary folder is chosen, and remembered in the session.
    """
    at = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(CHECKPOINT_CONF, at)
    return at


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers of all executors, once a session.

    Spark serves the archive from the driver, so the package need not be installed anywhere else.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._quern_shipped = True


def is_small(scan: DataFrame) -> bool:
    """Whether a file scan is read in less than half as many tasks as there are cores, so that shuffling it whole costs less than a job saved."""
    return 2 * scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver's JVM ends."""
    at = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that its lineage ends there.

    The files survive the loss of executors and are deleted when the driver's JVM ends.
    """
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``cut`` returned and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/quern-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
