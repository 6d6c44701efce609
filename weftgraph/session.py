"""Session helpers: a local session for tests and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "weftgraph", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WEFTGRAPH_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's ``spark.checkpoint.dir`` is used when it is set. Where it is
    unset, as in local tests, a temporary folder is made; on a cluster that is
    an error, as its executors would not share the folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="weftgraph-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives lost executors.

    Constraints are not carried over: for a union of checkpointed frames Spark
    looks them up by attributes that are gone and fails.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application.

    Python functions refer to its modules by name, and executors need not have
    the repository on their path.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph_package.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    sc._weftgraph_shipped = sc.applicationId


def shipped(queries: dict) -> dict:
    """Query callables (spark, sf_dir) that send the package along first."""
    import functools

    def wrap(f):
        @functools.wraps(f)
        def run(spark, sf):
            ship_package(spark)
            return f(spark, sf)

        return run

    return {k: wrap(f) for k, f in queries.items()}
