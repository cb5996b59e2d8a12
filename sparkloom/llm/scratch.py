"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a session on one machine; on a
    cluster, whose machines share no such folder, that is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not set_to and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get()


#: The blocks that are open, by thread: operators that run side by side don't see each other's tables.
_open: contextvars.ContextVar[tuple[temporary, ...]] = contextvars.ContextVar("_open", default=())


class temporary:
    """Intermediate tables of a block of code: at its end all that it stored go, but those it keeps.

    What the block returns must read only kept tables.  Spark deletes shuffle
    files when the driver's collector finds their plans unused, so it is asked
    to look.  After an error nothing is deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], []

    def __enter__(self) -> temporary:
        _open.set((*_open.get(), self))
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a stored table that outlives the block."""
        n = len(self.made)
        out = stored(df, name)
        self.kept += self.made[n:]
        del self.made[n:]
        return out

    def __exit__(self, kind, error, trace) -> None:
        rest = tuple(x for x in _open.get() if x is not self)
        _open.set(rest)
        if rest:
            rest[-1].made += self.kept
        if error is None:
            for path in self.made:
                _delete(self.spark, path)
            self.spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _open.get():
        _open.get()[-1].made.append(path)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the table read back.

    This cuts the lineage with replicated storage, so a lost executor costs
    only the tasks that it was running.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that no later step reads, and the shuffle files of finished plans."""
    for f in {os.path.dirname(x) for df in tables for x in df.inputFiles()}:
        _delete(spark, f)
    spark._jvm.System.gc()
