"""Helpers shared by the operators: stored tables, word tables, Arrow kernels."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.session import ensure_checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stored:
    """Tables of one operator run, in the folder named by ``spark.checkpoint.dir``.

    ``put`` writes a frame as Parquet and reads it back: that cuts its lineage, and
    a lost executor costs only the tasks of the step at hand. The shuffle files of
    a written step are released, as nothing reads them again. ``drop`` deletes
    tables that no later step needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("error").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512, max_bytes: int = 4 << 20):
    """An Arrow map function that hands ``fn`` slices of at most ``rows`` rows and, beyond the first row, about
    ``max_bytes`` of text, so that its working memory follows a slice and not Spark's batch size."""

    def run(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for col in batch.columns:
                if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                    size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(size)
            start = 0
            while start < batch.num_rows:
                before = total[start - 1] if start else 0
                end = min(start + rows, max(start + 1, int(np.searchsorted(total, before + max_bytes, "right"))))
                end = min(end, batch.num_rows)
                yield fn(batch.slice(start, end - start))
                start = end

    return run


def released() -> None:
    """Hand memory that a task has freed back to the system: a reused Python worker keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until it is none of the columns."""
    out = []
    for n in names:
        while n in columns:
            n += "_"
        out.append(n)
    return out


def smallest(df: DataFrame, by: str, k: int, *order: str, salts: int = 16) -> DataFrame:
    """The ``k`` rows of each value of ``by`` that come first in ``order`` (of the columns' hash, then the columns).
    Ranked within salted shares of a value first, so the last ranking reads at most salts * k rows of it."""
    df = df.withColumn("_hash", F.xxhash64(*order))
    for keys in ([by, F.pmod("_hash", F.lit(salts))], [by]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", *order))
        df = df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return df.drop("_hash")


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n``: the fold of a document."""
    return F.crc32(F.col(col).cast("string")) % n


def byte_table(keep, lower: bool = True) -> bytes:
    """256-entry table for ``bytes.translate``: bytes that are not kept become a space,
    A-Z become a-z. UTF-8 lead and continuation bytes (>= 0x80) stay."""
    out = bytearray(256)
    for b in range(256):
        out[b] = b if b >= 0x80 or keep(b) else 0x20
        if lower and 0x41 <= b <= 0x5A and keep(b):
            out[b] = b + 32
    return bytes(out)
