"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and driver and tasks share a machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumenfield-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """Names a fresh directory; ``save`` cuts lineage through Parquet, ``drop`` frees a table.

    Tables survive the loss of any executor, unlike a local checkpoint. An operator's result still reads
    its tables; whoever has written that result frees them by ``free_since``.
    """

    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        Workspace.made.append(self)

    @classmethod
    def free_since(cls, mark: int) -> None:
        """Deletes all workspaces but the first ``mark`` made; take ``len(Workspace.made)`` as the mark before."""
        while len(cls.made) > mark:
            last = cls.made.pop()
            last._delete(last.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.read(path, df)

    def read(self, path: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_workspace_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished jobs."""
        self.spark._jvm.System.gc()


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts a value of bounded size; its classes travel with it. Call the result on a worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list[Any] = []

    def get() -> Any:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get
