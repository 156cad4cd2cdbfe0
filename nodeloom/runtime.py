"""Settings read from the session: checkpoint folder, shuffle width, work folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that lineage cuts are written to.

    ``spark.checkpoint.dir`` names it. A temporary folder is used only when the setting is
    absent and the master is local; on a cluster a machine-local folder would be lost with
    its machine, so that case is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="nodeloom-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and forget how it was made."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as a written table.

    A checkpoint keeps the size estimate of its plan, and joins multiply estimates: over many
    rounds of joining a result with itself the estimate alone becomes too long to handle. A
    written table has the size of its files.
    """
    path = work_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scope:
    """What was stored inside a ``with lifetime(spark)`` block, to be released at its end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.frames: list[DataFrame] = []
        self.shared: list[Broadcast] = []

    def persist(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """``df``, kept at the storage level until the block ends."""
        self.frames.append(df.persist(level))
        return self.frames[-1]

    def broadcast(self, value) -> Broadcast:
        """A broadcast that is destroyed when the block ends."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def keep(self, df: DataFrame) -> DataFrame:
        """A result that outlives the block, as a table of its own."""
        out = store_table(df)
        self.paths.pop()
        return out

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()
        for value in self.shared:
            value.destroy()
        for path in self.paths:
            _delete(self.spark, path)


_SCOPES: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextmanager
def lifetime(spark: SparkSession) -> Iterator[Scope]:
    """Release all tables stored in the block, and what its scope persisted or broadcast, also after an error.

    Results that are read later go through :meth:`Scope.keep` or are computed inside.
    """
    scope = Scope(spark)
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield scope
    finally:
        _SCOPES.reset(token)
        scope.release()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table that :func:`store_table` returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("table-"):
            _delete(spark, folder)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; inside a lifetime it is removed at the end."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].paths.append(path)
    return path
