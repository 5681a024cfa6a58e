"""Session defaults and the shared folder for frozen intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # when a query ends


def local_session(cores: str = "8", app: str = "tuturan") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores).replace("*", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must see.

    Whoever sets it says that it is shared: a path without a scheme, or one of ``file:``, may be a
    mounted folder, and its name does not tell. A temporary folder stands in for it in local mode only;
    a cluster without one is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
    named = named or tempfile.mkdtemp(prefix="tuturan-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str = "stage", tidy: bool = False) -> DataFrame:
    """Write once to the shared folder and read back.

    Later passes prune columns, and Spark knows the bytes of a small table when it picks a join.
    With ``tidy`` the shuffle files of the write go at its end, else whenever the driver collects garbage.
    """
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    usual = conf.get(CLEANUP, None)
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.unset(CLEANUP) if usual is None else conf.set(CLEANUP, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)
