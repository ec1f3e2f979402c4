"""Intermediate tables and files in the folder that driver and executors share.

The folder is the one that `spark.checkpoint.dir` (or the context's checkpoint folder) names, on the file system that its
scheme or, without one, Hadoop's default names. Only a local master may do without: it gets a temporary folder. All data of
a session lie below one folder of its own, which the JVM deletes when it ends; `clear` deletes them sooner.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Session folders by application.
_roots: dict[str, str] = {}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def root(spark: SparkSession) -> str:
    """The session's own folder, as a URI with a scheme."""
    context = spark.sparkContext
    if (held := _roots.get(context.applicationId)) is not None:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (dir_ := context._jsc.sc().getCheckpointDir()).isDefined():
        named = dir_.get()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wheelgraph-")
    fs, at = _fs(spark, f"{named.rstrip('/')}/wheelgraph-{context.applicationId}")
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    made = re.sub(r"^file:/+", "file:///", fs.makeQualified(at).toString())
    _roots[context.applicationId] = made
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **measures) -> DataFrame:
    """`df` as a Parquet table: cuts lineage, survives lost executors, is never computed twice. `measures` are aggregates
    taken while writing, in `.measured` of the result."""
    spark, path, seen = df.sparkSession, folder(df.sparkSession, name), None
    if measures:
        seen = Observation()
        df = df.observe(seen, *[m.alias(k) for k, m in measures.items()])
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wheelgraph_path = path
    out.measured = seen.get if seen else {}
    return out


def parted(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` as a Parquet table with a folder for each value of `key`, so that reading some values reads no others."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.repartition(key).write.partitionBy(key).parquet(path)
    kinds = df.schema
    out = spark.read.schema(StructType([f for f in kinds if f.name != key] + [kinds[key]])).parquet(path)
    out._wheelgraph_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables of `written` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_wheelgraph_path", None):
            fs, at = _fs(df.sparkSession, path)
            fs.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate data of the session; results that still read them are lost."""
    fs, at = _fs(spark, root(spark))
    for found in fs.listStatus(at):
        fs.delete(found.getPath(), True)


def state(*columns: str) -> dict:
    """Measures that tell whether a table changed: its rows and a sum of hashes."""
    return {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))}
