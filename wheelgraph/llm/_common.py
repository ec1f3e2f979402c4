"""Table access, shared storage and Arrow limits for the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folder as shared_folder  # noqa: F401
from ..storage import remove, written  # noqa: F401

#: Rows of one Arrow batch: whole texts, so a batch of a Python worker stays at some MB.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of an input folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and, where this Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # an older Spark without the setting
        pass


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def open_fs(uri: str):
    """(file system, path) of a shared URI, for use on executors."""
    from pyarrow import fs

    # Hadoop's names of the S3 connector
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def small_rows(df: DataFrame, key: str, weight: str | None = None, each: int = 1) -> DataFrame:
    """The small rows of a manifest (one a file), dealt out so that a task opens `each` units of `weight` (or files) at
    least and no two tasks share a file. The number of tasks follows from the manifest, not from a setting.

    By a number of its own: a join's own partitioning by the key would be taken instead, which adaptive execution merges
    into one task, as the rows are small."""
    total = df.agg(F.sum(weight) if weight else F.count("*")).first()[0] or 0
    tasks = int(max(df.sparkSession.sparkContext.defaultParallelism, min(100_000, total // each)))
    return df.repartition(tasks, F.xxhash64(key))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, made: Column, out: str) -> DataFrame:
    """`df` with the new column `out`. A column of that name is kept as `out`_before (and underscores), never replaced."""
    own = [df[f"`{c}`"].alias(unused(df, f"{c}_before") if c.lower() == out.lower() else c) for c in df.columns]
    return df.select(*own, made.alias(out))


class Publishing:
    """A file that is written under a name of this attempt and moved into place when whole, so that a repeated or lost task
    leaves whole files only."""

    def __init__(self, filesystem, path: str):
        self.filesystem, self.path, self.part = filesystem, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out = filesystem.open_output_stream(self.part)

    def write(self, data: bytes) -> int:
        return self.out.write(data)

    def publish(self) -> None:
        self.out.close()
        self.filesystem.move(self.part, self.path)

    def discard(self) -> None:
        self.out.close()
        self.filesystem.delete_file(self.part)


def publish(filesystem, path: str, write) -> None:
    out = Publishing(filesystem, path)
    try:
        write(out)
    except BaseException:
        out.discard()
        raise
    out.publish()
