"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # attribute maps are merged with "the later map wins"
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings every operator expects to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", name: str = "pricetrail") -> SparkSession:
    """A single-machine session for tests and the local benchmark."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PRICETRAIL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    as in tests on one machine, a fresh folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="pricetrail-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _STAGED.append((spark.sparkContext, path))
    return path


TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over all cores, for work that is heavy per row.

    A compressed file of a million short rows is one split, so what is computed on its rows
    would run in one task, however many cores there are.
    """
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The same rows, dealt by keys into as many partitions as leave about ``ROWS_A_TASK`` of ``rows`` rows to each.

    Adaptive execution sizes partitions by their compressed bytes. Rows that compress well are many times that
    in memory, and all of it is a task's when they are sorted.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of frames that are made and read in the block go when they have been read, not when the driver next collects garbage.

    For results that are written or counted once; a frame made here is not to be read again after the block.
    """
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def staged(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared folder, and read it back.

    Used where recomputing is expensive or the plan would repeat a large piece.
    The table lies in the checkpoint folder, so it survives lost executors, and
    being columnar lets each step read only the columns it needs.
    """
    spark = df.sparkSession
    path = shared_path(spark, "staged")
    with shuffles_go(spark):
        df.write.parquet(path)
    if getattr(_SINCE, "paths", None) is not None:
        _SINCE.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """What make gives, staged; the tables that make has staged on the way are deleted, so it must not hand out frames that read them in any other way."""
    outer, _SINCE.paths = getattr(_SINCE, "paths", None), []
    try:
        made = make()
        on_the_way, _SINCE.paths = _SINCE.paths, []
        found = tuple(staged(df) for df in made) if isinstance(made, tuple) else staged(made)
        if outer is not None:
            outer.extend(_SINCE.paths)
    finally:
        _SINCE.paths = outer
    for table in [x for x in _STAGED if x[1] in set(on_the_way)]:
        _STAGED.remove(table)
        _delete(*table)
    return found


_STAGED: list[tuple[SparkContext, str]] = []
_SINCE = threading.local()  # paths: what this thread has staged since the innermost ``settled`` began


def _delete(context: SparkContext, path: str) -> bool:
    if context._jsc is None:  # stopped
        return True
    try:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    except (Py4JError, OSError):  # the JVM has gone before
        return False
    return True


@atexit.register
def clear_staged() -> None:
    """Delete the tables that this process has staged; frames that read them cannot be read again."""
    while _STAGED and _delete(*_STAGED.pop()):
        pass
