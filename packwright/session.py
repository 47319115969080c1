"""Where intermediate tables live, and the settings the jobs are written for."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings for a session of one's own (tests, bench). On a cluster the session
# that is passed in keeps its settings; nothing here is forced on it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_own_dirs: dict[str, str] = {}
# What has been staged inside the innermost ``staging``.
_staged: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is set and the
    session is local. On several machines each would write to a disk of its own."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="packwright-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, dropped when the driver's JVM ends."""
    folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def drop(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Drop the tables staged inside at the end: what needed them has been written by then."""
    outer, _staged[:] = list(_staged), []
    try:
        yield
    finally:
        for path in _staged:
            drop(spark, path.rsplit("/", 1)[0])
        _staged[:] = outer


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where a costly result (token ids) is read more than once: the reader
    prunes columns, and a lost executor does not make the work start over.
    """
    path = fresh_path(df.sparkSession, name)
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Stage what ``make`` gives, and drop all that was staged on the way to it.

    Also gives the folder, to ``drop`` it once the next step is written.
    """
    path = fresh_path(spark, name)
    folder = path.rsplit("/", 1)[0]
    try:
        with staging(spark):
            df = make()
            df.write.parquet(path)
    except BaseException:
        drop(spark, folder)
        raise
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path), folder
