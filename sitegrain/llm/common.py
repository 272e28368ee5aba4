"""Helpers that every corpus operator shares: shared-folder tables, bounded local tables, ids."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for Python stages over whole texts: long texts make large batches.
TEXT_BATCH_ROWS = 256


_own: list[str] = []  # the fallback folder of this process


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``; where that is unset, a local one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own.append("file://" + tempfile.mkdtemp(prefix="sitegrain-")) if not _own else None
        base = _own[0]
    return f"{base.rstrip('/')}/sitegrain-{uuid.uuid4().hex}"


_resident: dict[Hashable, Any] = {}


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's one resident model with its caches: it outlives tasks, until another operator's takes its place."""
    if key not in _resident:
        release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Drops the worker's resident model."""
    if _resident:
        _resident.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system where that is possible."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts the lineage: lost executors lose no finished work, and later
    jobs see the very same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes that no column of ``df`` begins with it, in any case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def drop(df: DataFrame) -> None:
    """Deletes a materialised table that is not read again."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def local_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table made inside the JVM from literal rows (bounded by the caller)."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a runtime setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def bucket_of(col: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus`` (the fold rule of the contracts)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
