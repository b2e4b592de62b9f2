"""Shared helpers: reading, scratch tables, ranges of words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts count it; every other character belongs to a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; own folder only in local mode without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="parallaxis-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and it is computed once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            jvm = table.sparkSession._jvm
            conf = table.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Bytes of one Arrow batch between Spark and Python; two directions and all cores of an executor hold some at once.
BATCH_BYTES = "4m"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches bounded by bytes, not by rows alone, whatever the length of the texts.

    A task gives its freed memory back to the system, because Python workers outlive their tasks.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(whole, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bound(value, make):
    """make(value) where value is computed once, however often make mentions it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def id_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text modulo a number; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
