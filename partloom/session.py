"""Sessions, shared folders and lineage cuts."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}
#: tables kept for the session, by application, folder, state of the folder's files and name
_kept: dict[tuple[str, str, str, str], str] = {}


def get_session(app: str = "partloom", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes (UTC, ANSI, AQE); conf overrides them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on a local master only, an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="partloom-")
        atexit.register(shutil.rmtree, _own_folder[app], True)
    return "file://" + _own_folder[app]


@contextmanager
def static_plans(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Plans fixed before they run, for loops of many small steps whose partitions (tasks) are chosen from the counts seen before.

    Adaptive planning submits and re-plans every shuffle of a step on its own; over hundreds of steps that is most of
    the time and of the driver's memory.
    """
    own = {"spark.sql.adaptive.enabled": "false"} | ({} if tasks is None else {"spark.sql.shuffle.partitions": str(tasks)})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files are deleted when it ends, not when the driver's memory is next cleared; for chains of written tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_session_folders: dict[str, str] = {}


def _session_folder(spark: SparkSession) -> str:
    """The session's own folder below the shared one; its file system deletes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _session_folders:
        _session_folders[app] = f"{shared_folder(spark)}/partloom/{app}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_session_folders[app])
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
    return _session_folders[app]


class Cuts:
    """Tables written to the shared folder to cut lineage; old ones are dropped when no longer read, all of them when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, partitions: int | None = None) -> tuple[DataFrame, int, str]:
        """(the table read back, its row count, its path); the count comes with the write, without a second job."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        seen = Observation()
        out = df if partitions is None else df.coalesce(partitions)
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get["n"]), path

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def state_of(spark: SparkSession, folder: str) -> str:
    """A text that changes whenever a file of the folder does: names, lengths and times of all files below it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether the table at a path was written whole and is still there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def kept(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over the files of a folder, built and written to the shared folder on first use and read from there later in the session.

    A change of any of the folder's files builds it anew, and so does the loss of the written table.
    """
    at = (spark.sparkContext.applicationId, folder, state_of(spark, folder), name)
    if at not in _kept or not is_written(spark, _kept[at]):
        table, _, path = Cuts(spark, "kept").write(build())
        _kept[at] = path
        return table
    return spark.read.parquet(_kept[at])
