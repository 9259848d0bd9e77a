"""Cut a plan's lineage by writing it as a table in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from functools import cache
from urllib.parse import urlparse
from uuid import uuid4
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from postlytics.sources.observed import ROWS, observe

#: Setting of a cluster whose machines mount the same folder at the same local path.
MOUNTED = "spark.postlytics.mountedFolder"
#: Setting for the tasks of each shuffle.
TASKS = "spark.sql.shuffle.partitions"
#: Setting under which the shuffle files of a plan go once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders on local disks, and whether all machines were found to share them.
_tried: dict[str, bool] = {}
#: Where staged tables lie.
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by ``spark.checkpoint.dir``, or else the warehouse on a cluster.

    A folder on a cluster's local disks may be mounted by all machines or be each one's own; it is tried out once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    # Executors of a local-cluster are programs of their own, with temp folders of their own.
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not folder and local:
        return _own_folder()
    folder = folder or spark.conf.get("spark.sql.warehouse.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    scheme = urlparse(folder).scheme or _default_scheme(spark)
    if scheme == "file" and not local and spark.conf.get(MOUNTED, "false") != "true" and not _reached(spark, folder.rstrip("/")):
        raise ValueError(f"spark.checkpoint.dir or the warehouse names {folder}, which not all machines were found to share; set {MOUNTED} to true if they do")
    return folder.rstrip("/")


def _reached(spark: SparkSession, folder: str) -> bool:
    """Whether what tasks on all cores write into ``folder`` is all found and read again, tried once a program and folder."""
    if folder not in _tried:
        path = f"{folder}/probe-{uuid4().hex}"
        try:
            tasks = 2 * spark.sparkContext.defaultParallelism
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            _tried[folder] = spark.read.schema("id long").parquet(path).count() == tasks
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            _remove(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path)
        except Exception:
            # Whatever fails here would fail on the tables too.
            return False
    return _tried[folder]


def _default_scheme(spark: SparkSession) -> str:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return urlparse(hadoop.get("fs.defaultFS", "file:///")).scheme or "file"


@cache
def _own_folder() -> str:
    """This program's own folder, for local sessions without a setting; removed at its end."""
    folder = tempfile.mkdtemp(prefix="postlytics-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file:{folder}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver program ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_remove, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path)
    return path


def _remove(file_system, jvm_path) -> None:
    # The JVM may be gone already; then the folder's owner has to clear it.
    with contextlib.suppress(Py4JError, ConnectionError):
        file_system.delete(jvm_path, True)


def cut_lineage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` once and go on from the written table.

    A written table survives the loss of executors, costs one pass where
    ``checkpoint()`` costs two, and gives later joins a known size. Its shuffle
    files go when it is written: nothing else reads them, and they would stay
    until the driver happens to collect its garbage.
    """
    path = scratch_path(df.sparkSession, label)
    with _setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[staged] = path
    return staged


def cut_lineage_counted(df: DataFrame, label: str, counts: Mapping[str, str] = ROWS) -> tuple[DataFrame, dict[str, int]]:
    """``cut_lineage``, and ``counts`` (name to SQL aggregate) of the rows, taken while they are written."""
    watched, told = observe(df, counts)
    return cut_lineage(watched, label), told()


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` is set to ``value`` while it lasts, and to what it was before after that."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def shuffles_for(spark: SparkSession, rows: int, rows_per_task: int) -> Iterator[int]:
    """While it lasts, plans that run shuffle into as many tasks as ``rows`` need, one a core at least; gives that number.

    The cluster's own setting is for its largest tables. The driver keeps a record
    of each task and of what each sends to each other, so that many short stages
    over few rows cost it more memory than all their rows take.
    """
    tasks = min(int(spark.conf.get(TASKS)), max(spark.sparkContext.defaultParallelism, rows // rows_per_task + 1))
    with _setting(spark, TASKS, str(tasks)):
        yield tasks


def forget(spark: SparkSession) -> None:
    """Let go of what plans that have run still hold: their broadcasts, on all machines, and their compiled code.

    Spark drops these when the driver collects its garbage, which a driver that
    runs many plans over few rows of its own does late.
    """
    gc.collect()
    spark._jvm.System.gc()


def free(staged: DataFrame) -> None:
    """Remove the table behind what ``cut_lineage`` gave; nothing made from it may be read after that."""
    path = _staged.pop(staged, None)
    if path:
        jvm_path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        _remove(jvm_path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()), jvm_path)
