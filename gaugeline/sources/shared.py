"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (a local master) may have none: a folder of
    our own is made and set there.  On a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="gaugeline-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/gaugeline-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables of the scratches that are open, the inner ones last.
_SCRATCH: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


def remember(table: DataFrame, path: str, keep: bool = False, name: str | None = None) -> DataFrame:
    """Have a table under a path (and of a name in the catalog) go when the open scratch ends; with ``keep`` the one around it."""
    table.settled_at, table.settled_as = path, name
    stack = _SCRATCH.get()
    at = len(stack) - (2 if keep else 1)
    if at >= 0:
        stack[at].append(table)
    return table


def settle(df: DataFrame, name: str, few: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage with files every executor can read, so a lost executor
    costs no recomputation of what lies before.  ``few`` is for sums and edges,
    rows of a few numbers: what all tasks have computed is dealt evenly to an
    eighth as many files.  In a ``scratch`` only tables to ``keep`` outlive it.
    """
    path = fresh_path(df.sparkSession, name)
    if few:
        df = df.repartition(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return remember(df.sparkSession.read.schema(df.schema).parquet(path), path, keep)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables settled inside are deleted at its end: what is used after it must be written with ``keep``."""
    outer = _SCRATCH.set((*_SCRATCH.get(), []))
    try:
        yield
    finally:
        held = _SCRATCH.get()[-1]
        _SCRATCH.reset(outer)
        release(*held)


def finished(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` describes, written; all that was settled on the way is deleted."""
    with scratch():
        return settle(build(), name, keep=True)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no plan reads any more."""
    for table in tables:
        if table.settled_as:
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.settled_as}")
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
