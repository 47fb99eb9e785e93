"""Session helpers that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Only a local session without that setting (tests, one machine) gets a
    folder of its own; on a cluster its absence is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def freed(spark: SparkSession):
    """Inside the block, the shuffle files of a query go as soon as it has its result."""
    return setting(spark, _CLEANUP, "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage with files that outlive any executor, so the shuffles behind them go as soon as they are
    written. Column pruning and filters reach those files. Inside scratch(), the files go when that ends.
    """
    return _stored(df, name)


def stored_count(df: DataFrame, name: str, where: str = "true") -> tuple[DataFrame, int]:
    """stored() and the number of rows that meet a condition, counted while they are written."""
    seen = Observation()
    return _stored(df.observe(seen, F.count_if(F.expr(where)).alias("n")), name), seen.get["n"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if open_ := _scopes():
        open_[-1].append(out)
    return out


_LOCAL = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


@contextmanager
def scratch() -> Iterator[None]:
    """Frees, when it ends, the tables stored inside, but for those given to keep()."""
    _scopes().append([])
    try:
        yield
    except BaseException:
        _scopes().pop()
        raise
    discard(*_scopes().pop())


def keep(df: DataFrame) -> DataFrame:
    """df, a table stored inside scratch(), left to the scope around it, if there is one."""
    open_ = _scopes()
    for at in range(len(open_) - 1, -1, -1):
        if any(x is df for x in open_[at]):
            open_[at] = [x for x in open_[at] if x is not df]
            if at:
                open_[at - 1].append(df)
            break
    return df


def _folder(df: DataFrame) -> tuple | None:
    """The file system and path of a table from stored(); None once it has no files."""
    files = df.inputFiles()
    if not files:
        return None
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0].rsplit("/", 1)[0]))
    return path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), path


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table from stored()."""
    found = _folder(df)
    return found[0].getContentSummary(found[1]).getLength() if found else 0


def shuffled_bytes(spark: SparkSession) -> int:
    """Bytes that all executors have written to shuffles so far, by Spark's own record of the application."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    each = context.statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of tables from stored() that nothing will read again."""
    for df in frames:
        if df is not None and (found := _folder(df)):
            found[0].delete(found[1], True)
