"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType

#: Removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writes under way in a session, and the setting before the first of them.
_writing: dict[int, tuple[int, str]] = {}
_lock = threading.Lock()
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder; a temporary one only where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are removed at once while any write of the session is under way; then the setting is as before."""
    key = id(spark)
    with _lock:
        n, before = _writing.get(key, (0, spark.conf.get(_CLEANUP, "false")))
        _writing[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and its shuffle files go.

    Inside scratch() the table goes with its folder, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{(not keep and _folder.get()) or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Arrays of longs are hashes, which a dictionary doesn't shorten.
    longs = [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, LongType)]
    plain = {f"parquet.enable.dictionary#{name}.list.element": "false" for name in longs}
    with _cleaning(spark):
        df.write.options(**plain).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for the tables staged meanwhile, removed at the end, also after an error."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(before)
        _delete(spark, path)


def tidy(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose result is written once, and of whose other tables nothing stays."""

    @wraps(run)
    def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark, run.__name__):
            return staged(run(spark, sf_dir), f"{run.__name__}-result", keep=True)

    return whole
