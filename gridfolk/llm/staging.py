"""Tables written to the shared folder between the steps of an operator.

Any executor may be lost at any time, so intermediate results are Parquet
tables in the folder that the cluster names in ``spark.checkpoint.dir``:
they outlive executors and cut the lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])
_STAGED: list[str] = []
_OWN: ContextVar[list[str] | None] = ContextVar("gridfolk_own_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only a local session without the setting gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used; :func:`clear_staged` deletes it."""
    path, own = f"{shared_dir(spark)}/gridfolk-{uuid.uuid4().hex}", _OWN.get()
    (_STAGED if own is None else own).append(path)
    return path


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again with its own schema."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """A list that holds the tables staged inside, whatever other threads stage; those left at the end join all others."""
    token = _OWN.set([])
    try:
        yield _OWN.get()
    finally:
        _STAGED.extend(_OWN.get())
        _OWN.reset(token)


def clear_staged(spark: SparkSession, tables: list[str] | None = None, but_last: bool = False) -> None:
    """Delete the tables of a list, by default all that no :func:`own_tables` holds (perhaps all but the last), once results that read them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tables = _STAGED if tables is None else tables
    for name in tables[: len(tables) - but_last]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        tables.remove(name)


def importable(spark: SparkSession) -> None:
    """Let the Python workers of this machine import the library from any working folder."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])
