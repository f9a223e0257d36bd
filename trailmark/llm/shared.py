"""Places that the driver and every executor can see, and tables written there."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Without that setting a folder of this machine is used, which only a local
    master can share with its executors; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="trailmark-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch, at most. A batch of whole texts lies in the JVM's native memory and in the worker
#: several times over, and the default of 10,000 rows is made for numbers.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends Python workers batches of texts, where its own limits are larger."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"[^\d-]", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, most)


def give_back() -> None:
    """Hands memory that a Python worker has freed back to the machine: it outlives its task, beside an executor that needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
