"""Session helpers shared by every operator: table access, lineage cuts, parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "glossa", cores: str = "*", **conf: str) -> SparkSession:
    """A session for local use; on a cluster the caller's own session is used instead."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, wherever they run.

    Spark copies the archive to every executor, also to those that join later.
    """
    sc = spark.sparkContext
    if getattr(sc, "_glossa_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="glossa-py-"), "glossa.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("glossa", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._glossa_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (tests, a
    laptop) a local folder is set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="glossa-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and forget its lineage, by a reliable checkpoint.

    The files live in the shared folder, so a lost executor costs nothing, and
    Spark's cleaner removes them when the frame is no longer referenced.
    """
    shared_dir(df.sparkSession)
    with _shuffles_end(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a frame keeps the setting that it was made under


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For results that are read by several later stages and are wide enough for
    columnar compression and column pruning to matter. The folders of a session
    are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"glossa-{name}-{uuid.uuid4().hex}")
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    with _shuffles_end(spark):
        df.select("*").write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove the files of ``stored`` frames that no later step reads; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "_glossa_path", None):
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files of a query run here are removed when it ends, not when the driver collects its garbage: its result is in files."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _splits(df: DataFrame) -> int | None:
    """How many splits a plain scan of files has; None for any other plan."""
    plan = df._jdf.queryExecution().sparkPlan()
    while plan.children().size() == 1:
        if any(x in plan.nodeName() for x in ("Exchange", "Aggregate", "Sort", "Window", "Limit", "Repartition")):
            return None
        plan = plan.children().head()
    return df._jdf.queryExecution().toRdd().getNumPartitions() if plan.nodeName().startswith("Scan") else None


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan that came as fewer splits than the cluster has cores.

    A no-op on large inputs, whose scan already has many splits, and on plans
    that shuffle, whose partitions adaptive execution sizes; a single small file
    would otherwise keep one core busy with all of a Python stage.
    """
    ship(df.sparkSession)
    n = least or df.sparkSession.sparkContext.defaultParallelism
    splits = _splits(df)
    return df.repartition(n) if splits is not None and splits < n else df


def sized_broadcast(df: DataFrame, limit_rows: int) -> tuple[bool, DataFrame]:
    """(True, broadcast hint) if ``df`` has at most ``limit_rows`` rows, else (False, df)."""
    from pyspark.sql import functions as F

    small = df.limit(limit_rows + 1).count() <= limit_rows
    return small, F.broadcast(df) if small else df
