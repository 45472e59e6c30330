"""Session helpers: test and bench sessions, and staged tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: settings this library relies on; the number of shuffle partitions stays the cluster's choice
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "*", app: str = "cohortspark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session."""
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Python functions get Arrow batches of at most ``rows`` rows; a smaller setting of the session stays.

    An executor holds a few batches for each task, in its own memory and in Python, and 10,000 whole texts are some 50 MB each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; only a local session without one gets its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="cohortspark-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


#: paths of staged tables, oldest first
_STAGED: list[str] = []


def staged(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write a frame that is used several times to the shared folder once, and read it back.

    Cuts the lineage, survives lost executors, and later reads prune columns and know the size. ``by``
    partitions the files, for readers that want a few values of these columns at a time.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_staged() -> str:
    """Where the latest staged table is."""
    return _STAGED[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _STAGED:
        _STAGED.remove(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the staged tables written inside it.

    Frames that read them must have been written or collected by then.
    """
    first = len(_STAGED)
    try:
        yield
    finally:
        for path in _STAGED[first:]:
            discard(spark, path)
