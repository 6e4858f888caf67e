"""Reading the tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BUILT: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` gives for the tables of ``folder``, built at first use in this application and kept: tables that change need another folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, as it is named; a local session that names none gets its own.

    A cluster must name one: a folder of the driver's own disk isn't seen by its executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lodeline-")
        context.setCheckpointDir(named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, *replaces: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: without lineage, with its real size.

    A lost executor costs nothing that is written. The tables ``replaces``, earlier cuts that nothing
    reads any more, are deleted; what is left goes when the program ends. The order of rows isn't kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OPEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    discard(*replaces)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes cut tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_cut_at", None)
        if path in _OPEN:
            _delete(_OPEN.pop(path), path)


def kept_in_order(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: its lineage is cut, its partitions and the order in them stay."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_OPEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before
            return
