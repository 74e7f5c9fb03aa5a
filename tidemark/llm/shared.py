"""What the operators share: the shared folder, tables, and names that can't clash."""

from __future__ import annotations

import ctypes
import platform
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir, stored


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
    return name


#: Rows of a batch that goes to a Python worker; the engine's own default is 10,000.
ROWS_A_BATCH = 2_000


def lean(run):
    """A function for mapInArrow that holds less memory: smaller batches, and what a task has
    freed goes back to the system before the worker waits for the next one."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    """Gives freed memory back, where the C library can."""
    pa.default_memory_pool().release_unused()
    if platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)
