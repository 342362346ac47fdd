"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: `spark.checkpoint.dir`. Where it is unset a session on one machine gets one of its own; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file:" + tempfile.mkdtemp(prefix="citeresolve-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_RUN = uuid.uuid4().hex


def run_dir(spark: SparkSession) -> str:
    """This process's own folder in the shared one; removed when the process ends."""
    at = f"{shared_dir(spark).rstrip('/')}/citeresolve-{_RUN}"
    if at not in _OPEN:
        _OPEN.add(at)
        atexit.register(_remove, spark, at)
    return at


_OPEN: set[str] = set()


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: what lies on this machine can still go
        shutil.rmtree(at.removeprefix("file:"), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing Python stages) and gives the
    optimizer true sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for `df`; no other table may still be read from it."""
    path = df.__dict__.pop("_written", None)
    if path:
        _remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer partitions than cores: only ahead of work that costs far more per row than moving the row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


def local_session(cpus: int | str = 8, shuffle: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citeresolve")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
