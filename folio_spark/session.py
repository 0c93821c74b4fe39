"""Session and path helpers shared by operators, queries and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a dataset folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str, cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def scratch(spark: SparkSession, label: str, name: str | None = None) -> str:
    """A new folder (or that of a name) below spark.checkpoint.dir, which all machines share; a local session without one uses the temp folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{name or uuid.uuid4().hex}"


def spooled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: what several steps go on from is computed once, and lineage is cut."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def finish(spark: SparkSession, part: str, path: str) -> bool:
    """Move a complete folder to its lasting place, unless another job did so first; a mark says that it is whole."""
    fs, at = _path(spark, path)
    if fs.exists(at):
        return fs.exists(_path(spark, f"{path}/done")[1])
    fs.mkdirs(at.getParent())
    if not fs.rename(_path(spark, part)[1], at):
        return fs.exists(_path(spark, f"{path}/done")[1])
    return fs.createNewFile(_path(spark, f"{path}/done")[1])


def drop_scratch(spark: SparkSession, label: str) -> None:
    """Delete the folders of a label that scratch() named, once nothing reads them."""
    fs, at = _path(spark, scratch(spark, label, "*"))
    for status in fs.globStatus(at) or []:
        fs.delete(status.getPath(), True)
