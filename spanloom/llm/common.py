"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, in local mode alone a temporary folder stands in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def crc_mod(column: str, m: int) -> Column:
    """crc32(column as text) mod m; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % m


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def local_path(uri: str) -> str:
    """A path for Python's own file calls, where the shared folder is a mounted one."""
    return uri.removeprefix("file://") if uri.startswith("file://") else uri


def thread_limits() -> None:
    """One core a task: keep numpy's and the tokenizers' own threads out of the way."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
