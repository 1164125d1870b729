"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

# A join side that repeats one key in a third of its rows is split at run time even where the
# split costs another exchange, and a table already partitioned by customer is not shuffled again
# for a join on (customer, item). Where every partition of a join side is measured to be small, the
# join hashes that side instead of sorting both. Rows of a few numbers fill memory with many times
# the bytes they were shuffled in, so a task is given 16 MB of them.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """A session of its own beside the caller's, with the caller's settings and those above; the caller's stays as it is."""
    own = spark.newSession()
    for key, value in {**dict(spark.conf.getAll), **_RUNTIME}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for lineage cuts: the cluster's shared folder; where none is set in local mode, a scratch folder that goes with the process."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="shoprank-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage but keep the partitioning, for loops over the same frame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: paths that `written` makes for the block of code that runs now, where one wants them removed
_OWNED: ContextVar[list[str] | None] = ContextVar("shoprank_owned", default=None)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the checkpoint folder, for results that are read several times.

    A lost executor then costs a read, the columns can be pruned and the planner knows the size.
    Inside `temporary_tables` the table goes when the block ends. Its shuffle files go when it is written.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/shoprank-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    with released_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: lets a query remove its shuffle files when it ends; else they stay until the driver collects garbage
_RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """For queries that end in a table: nothing reads their shuffle files again."""
    before = spark.conf.get(_RELEASED, None)
    spark.conf.set(_RELEASED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASED)
        else:
            spark.conf.set(_RELEASED, before)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that `written` makes inside: they are removed at the end, after an error too.

    For code that ends in a table of its own, or in nothing lazy.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def side_by_side(fn: Callable, items: Iterable, most: int = 4) -> list:
    """`fn` of every item, up to `most` at a time; their Spark jobs share the cluster, so small ones don't wait for each other."""
    def run(item):
        # each call sees the owner of temporary tables that its caller sees
        return owner.copy().run(fn, item)

    owner, session = copy_context(), SparkSession.getActiveSession()
    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(session)(run) if session else run, list(items), chunksize=1)
