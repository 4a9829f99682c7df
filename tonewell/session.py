"""Session helpers: reading tables and choosing the folder that lineage is cut in."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Tables that written() made and nothing has deleted yet.
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A cluster names it in `spark.checkpoint.dir`, which every executor shares. Only where neither that
    setting nor a folder of the context exists (tests, one machine) a temporary one is made.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = _FALLBACK.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tonewell-"))
    context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read from there: a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a parquet table in the checkpoint folder.

    Like checkpoint(), but its size on disk is known to the planner, which then broadcasts it only if it is
    small enough for `spark.sql.autoBroadcastJoinThreshold`, and a step reads only the columns it needs. It is deleted when
    the scratch() around it ends, else by release() or at the end of the process: a plan made from it is read before.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Deletes the tables that written() made, or those after the first `since` of them."""
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone, and with it the way to its folder
            continue


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside are deleted at the end: write or collect what is made of them before."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release(since)


atexit.register(release)
