"""Helpers of the training-data operators: tables, shared folders, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. A local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def spool(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Like checkpoint(), but the plan runs once. A lost executor costs only a new read of these files. They carry the
    application's id and stay until drop_spools() or until the folder is cleared.
    """
    path = f"{shared_dir(df.sparkSession)}/spool-{df.sparkSession.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spools(spark: SparkSession) -> None:
    """Delete what spool() wrote in this application, once the results that read it are stored."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/spool-{spark.sparkContext.applicationId}-*")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(pattern) or []:
        fs.delete(status.getPath(), True)


def drop_spool(df: DataFrame) -> None:
    """Delete what spool() wrote for df, once nothing that is still to run reads it."""
    spark = df.sparkSession
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f"/spool-{spark.sparkContext.applicationId}-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, of: int) -> Column:
    """The fold of a document: crc32 of its id, written as text, modulo `of`. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(*cols: Column) -> Column:
    """32 hex digits that depend on all columns and on which of them are null; any SQL engine can compute them."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]).cast("binary"))


def digest_number(*cols: Column) -> Column:
    """The first 32 bits of the digest."""
    return F.conv(F.substring(digest(*cols), 1, 8), 16, 10).cast("long")


def by_group(df: DataFrame, group: str, run: Callable[[pa.Table], list[tuple]], shape: str) -> DataFrame:
    """The rows (shape) that run gives for each group of df, told apart by the long column `group`.

    Like applyInPandas, for many small groups: rows come to tasks sorted by group, in Arrow batches, so a group costs no
    more than its rows. A group is in one task's memory and has to be of bounded size.
    """
    names = [x.split()[0] for x in shape.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(group)).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            rows: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and ids[a] != last:
                    rows += run(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = ids[a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
        if held and (rows := run(pa.Table.from_batches(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return df.repartition(partitions(df.sparkSession), group).sortWithinPartitions(group).mapInArrow(of, shape)
