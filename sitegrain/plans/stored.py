"""Tables that a query writes once and reads often: Parquet below the session's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []  # the fallback folder of this process


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, a local one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sitegrain-"))
        base = _own[0]
    return f"{base.rstrip('/')}/sitegrain-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` and reads it back; this cuts the lineage, and lost executors lose no finished work."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> str:
    """Writes ``df`` and returns where."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return path


_kept: dict[tuple, str] = {}  # what `once` has written: where, by session, name and state of the inputs


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another state is another table."""
    fs, p = _hadoop(spark, path)
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.getFileStatus(p).isDirectory()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def once(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> str:
    """Where the table ``name`` over ``inputs`` is written: by an earlier query of this application, if they have not changed since, or now."""
    key = (spark.sparkContext.applicationId, name, *(state_of(spark, p) for p in inputs))
    if key not in _kept or not exists(spark, f"{_kept[key]}/_SUCCESS"):
        _kept[key] = written(make(), name)
        if len(_kept) == 1:
            atexit.register(forget, spark)
    return _kept[key]


def forget(spark: SparkSession) -> None:
    """Deletes the tables of ``once``; also done when the process ends."""
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in _kept.values():
            fs, p = _hadoop(spark, path)
            fs.delete(p, True)
    _kept.clear()
