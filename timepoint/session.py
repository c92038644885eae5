"""Session settings the library needs, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Folder below the shared one that ``scratch_space`` has set for the session, if any.
_spaces: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session, where nothing is set, falls back to a temporary
    folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="timepoint-"))
    return sc.getCheckpointDir()


def new_scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    root = _spaces.get(spark.sparkContext.applicationId) or scratch_root(spark)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, computed once, from a table in the shared folder; what reads them does not compute them again."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is written meanwhile; it is removed at the end, so results have to be used inside."""
    app = spark.sparkContext.applicationId
    before, path = _spaces.get(app), new_scratch(spark, "space")
    _spaces[app] = path
    try:
        yield path
    finally:
        _spaces.pop(app)
        if before:
            _spaces[app] = before
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(spark))


def local_session(cores: int | str = 8, name: str = "timepoint", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Small test tables: keep all cores busy instead of filling 1 MB partitions.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
