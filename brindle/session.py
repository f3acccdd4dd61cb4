"""Session helpers: tables, shared checkpoint folder, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "brindle", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is read from ``spark.checkpoint.dir``; only where that is unset and the
    session runs in this process alone (tests, local runs) a temporary folder of this machine takes its place."""
    sc = spark.sparkContext
    if (at := sc._jsc.sc().getCheckpointDir()).isDefined():
        return at.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        folder = tempfile.mkdtemp(prefix="brindle-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session was sized for; everything that needs a number of buckets scales with it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_TABLES: list[tuple[SparkSession, str]] = []


def cut_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder. Against ``cut`` it is compressed, its repeated values are
    dictionary-encoded and later reads take only the columns they need. ``release`` deletes the tables; so does the
    end of the Python process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/brindle-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(release)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete one table of ``cut_table`` that later rounds have replaced."""
    for spark, path in [t for t in _TABLES if any(f"/{t[1].rpartition('/')[2]}/" in f for f in df.inputFiles()[:1])]:
        _TABLES.remove((spark, path))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete what ``cut_table`` wrote; frames that still read it can't be used any more."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return
