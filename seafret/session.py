"""Session helpers: builder settings, the shared folder, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from threading import Condition, local

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}

#: Share of the storage memory that fits side by side may take together.
CACHE_SHARE = 0.4
_taken: dict[str, int] = {}
_freed = Condition()
_pool = local()


def local_session(cores: str = "8", memory: str = "16g", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seafret")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="seafret-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seafret/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and continue from the written table.

    Iterative jobs (many fits over one table) then neither recompute the whole
    feature plan nor lose it with an executor, and later scans still prune columns.
    """
    path = path or new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Empty a folder that `materialize` wrote: its files go, what was read from it can be read no more."""
    spark.createDataFrame([], "discarded boolean").coalesce(1).write.mode("overwrite").parquet(path)


def in_threads(work: Callable, items: Iterable, parallelism: int = 4) -> list:
    """Submit jobs of independent items side by side."""
    items = list(items)
    width = side_by_side() * max(1, min(parallelism, len(items)))

    def one(item):
        _pool.width = width
        return work(item)

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(one), items)


def side_by_side() -> int:
    """How many items all the pools around this thread work on at once."""
    return getattr(_pool, "width", 1)


def storage_memory(spark: SparkSession) -> int:
    """Bytes in which all executors together can keep blocks."""
    known, total = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator(), 0
    while known.hasNext():
        total += known.next()._1()
    return total


def fits_in_room(spark: SparkSession, size: int) -> int:
    """How many fits of `size` bytes `cache_room` lets start at once, at least one."""
    return max(1, int(CACHE_SHARE * storage_memory(spark) // max(1, size)))


@contextmanager
def cache_room(spark: SparkSession, size: int) -> Iterator[None]:
    """Wait until `size` bytes fit beside what others keep in memory; more than there is room for goes alone.

    Blocks of too many fits at once push each other to disk and are read back in every pass.
    """
    app, most = spark.sparkContext.applicationId, CACHE_SHARE * storage_memory(spark)
    with _freed:
        _freed.wait_for(lambda: not _taken.get(app) or _taken[app] + size <= most)
        _taken[app] = _taken.get(app, 0) + size
    try:
        yield
    finally:
        with _freed:
            _taken[app] -= size
            _freed.notify_all()
