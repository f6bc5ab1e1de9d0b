"""Tables that cut lineage: written to the folder all executors share, then read again."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session in one process that names none (tests) gets a temporary one; on a cluster that is an error,
    as no executor would see another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What queries stage inside goes when the block ends, so that a long application does not fill the shared folder. Results must be written or
    collected inside; a query's result reads staged tables until then."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: While tables are staged: Spark removes the shuffle files of a query when it ends, and sends Python small batches.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock = threading.Lock()
_staging: dict[SparkSession, tuple[int, dict[str, str | None]]] = {}


def _begin(spark: SparkSession) -> None:
    with _lock:
        n, before = _staging.get(spark, (0, {}))
        if not n:
            before = {k: spark.conf.get(k, None) for k in _WHILE}
            for k, v in _WHILE.items():
                spark.conf.set(k, v)
        _staging[spark] = (n + 1, before)


def _end(spark: SparkSession) -> None:
    with _lock:
        n, before = _staging.pop(spark)
        if n > 1:
            _staging[spark] = (n - 1, before)
            return
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write(df: DataFrame, path: str) -> None:
    """Write df under the settings above."""
    _begin(df.sparkSession)
    try:
        df.write.parquet(path)
    finally:
        _end(df.sparkSession)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return the written table, so that a lost executor never replays what came before. The shuffle
    files behind it go when it is written; nothing reads them any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write(df, path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def unstage(*staged: DataFrame) -> None:
    """Remove tables that stage() wrote and nothing reads any more, so that scratch space stays small."""
    for df in staged:
        _remove(df.sparkSession, df.staged_path)
