"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z and nothing else.
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder spark.checkpoint.dir. Where that is unset a local master (tests) gets a new folder; on a cluster,
    where a local folder would be lost, that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: lineage ends there and survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def unit_hash(column: str) -> Column:
    """A number in [0, 1) that depends on the id alone; used for bounded training samples."""
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def sample_rate(rows: int, bound: int) -> float:
    """The share of rows that keeps a training sample near `bound` rows."""
    return 1.0 if rows <= bound else bound / rows


def durable_table(df: DataFrame) -> DataFrame:
    """Like `durable`, as compressed Parquet in a folder of its own."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that nothing reads any more."""
    for t in tables:
        if files := t.inputFiles():
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
