"""What the engine asks of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def package_zip(folder: str) -> str:
    """This package as a zip that Python can import from."""
    path = os.path.join(folder, "sparkloom.zip")
    top = os.path.join(ROOT, "sparkloom")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for place, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(place, n), os.path.relpath(os.path.join(place, n), ROOT))
    return path


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Spark's Python workers import this package.

    On one machine they read it where it is; on a cluster the driver serves it as
    a zip to each executor, once a session.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        if not any(f.endswith("/sparkloom.zip") for f in sc.listFiles):
            sc.addPyFile(package_zip(tempfile.mkdtemp(prefix="spark-")))  # the driver's own: it sends the file
        return spark
    env = sc.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    Where it is unset, a temporary folder serves a session on one machine; on a
    cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_system(path: str):
    """(Arrow's file system, the path there) of a local path or a URI, as Hadoop or others write it."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        path = path.removeprefix("file:").removeprefix("//")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _columnar(kind: T.DataType) -> bool:
    """Whether Parquet holds values of a type."""
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind.fields}
        return 0 < len(names) == len(kind.fields) and all(_columnar(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _columnar(kind.elementType)
    if isinstance(kind, T.MapType):
        return _columnar(kind.keyType) and _columnar(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def settled(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the folder of spark.checkpoint.dir.

    Results of external calls are settled at once, so that a retried task or a
    second use doesn't call again.  They are written as Parquet, so that what
    follows reads only the columns and row groups that it needs; rows that
    Parquet can't hold (columns without a type, without a field, or that differ
    in case alone) are checkpointed as rows.
    """
    folder = shared_folder(df.sparkSession)
    if not _columnar(df.schema):
        return df.checkpoint()
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
