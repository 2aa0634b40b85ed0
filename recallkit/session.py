"""Session set-up and materialisation in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "recallkit", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine expects: UTC, AQE, Arrow."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets one in the temp folder; a cluster raises."""
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if set_by:
        return set_by
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/recallkit-checkpoints"
    raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")


#: Paths of tables written and not deleted yet, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            fs, p = _filesystem(spark, path)
            fs.delete(p, True)
        except (Py4JError, OSError, AttributeError, TypeError):  # the JVM is gone already: the cluster's own clean-up applies
            return


atexit.register(_clean)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    Unlike localCheckpoint() the rows survive a lost executor, and unlike checkpoint() the copy is
    columnar and compressed, so later readers can prune columns. Files go with `discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recallkit/{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for files of a caller's own, which go when the driver ends."""
    path = f"{shared_dir(spark)}/recallkit/{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path and _WRITTEN.pop(path, None):
            fs, p = _filesystem(df.sparkSession, path)
            fs.delete(p, True)


#: In-memory bytes of one value of a type of fixed width; other values are measured by their files.
_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def table_bytes(df: DataFrame) -> int:
    """An upper estimate of the memory of a table that `materialize` wrote: five times its files, and at least its rows' fixed widths."""
    fs, p = _filesystem(df.sparkSession, df._written)
    return max(5 * fs.getContentSummary(p).getLength(), df.count() * (16 + sum(_WIDTH.get(kind, 8) for _, kind in df.dtypes)))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast of df only if its size was measured to be within max_bytes; else the join shuffles.

    df is materialized first, unless `materialize` gave it.
    """
    df = df if hasattr(df, "_written") else materialize(df)
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df
