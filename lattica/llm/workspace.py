"""Shared-folder tables that cut lineage between steps of an operator.

Every intermediate is a Parquet table under the folder that the session names in
``spark.checkpoint.dir``, so a step can be read again after an executor is lost.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Result tables that :meth:`Workspace.finish` has left and nobody has discarded.
_RESULTS: list[str] = []
#: Stages after which a run lets Spark drop what finished ones hold.
_RELEASE = 6


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in a local session without one, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # In a local session driver and executors are one process.
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove_local, found)
    return found.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems; a missing one is fine."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def results() -> int:
    """How many result tables operators of this process have left."""
    return len(_RESULTS)


def discard_results(spark: SparkSession, since: int = 0) -> None:
    """Delete the result tables left after the first ``since`` ones; whoever read them is done."""
    while len(_RESULTS) > since:
        delete_path(spark, _RESULTS.pop())


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and broadcasts of finished steps.

    Spark drops them when the driver has collected what refers to them, which a driver
    with little to do puts off; its heap would grow with the number of steps meanwhile.
    """
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """Stages of one run. ``finish`` keeps only the result table and drops the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def stage(self, df: DataFrame, label: str = "step") -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(label)
        df.write.parquet(path)
        if self._n % _RELEASE == 0:
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, label: str = "step", what: Column | None = None) -> tuple[DataFrame, int]:
        """As :meth:`stage`, and the number of rows, or of those where ``what`` is true.

        The write itself counts, so no job is spent on it.
        """
        seen = Observation()
        count = F.count(F.lit(1)) if what is None else F.count_if(what)
        staged = self.stage(df.observe(seen, count.alias("n")), label)
        return staged, int(seen.get["n"] or 0)

    def drop(self, *staged: DataFrame) -> None:
        """Delete staged tables that no later step reads."""
        for df in staged:
            for file in df.inputFiles()[:1]:
                delete_path(self.spark, file.rsplit("/", 1)[0])

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result beside the workspace, drop the intermediates, read it back."""
        path = f"{self.root}-result"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        delete_path(self.spark, self.root)
        _RESULTS.append(path)
        return out
