"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may do without one: it has a single machine
    and gets a folder in its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir isn't set: steps are written to the folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tarnwerk-steps"


class Workspace:
    """Written tables: they cut the lineage, and a lost executor costs only its own tasks. They are deleted
    when no later step reads them, or at the latest when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tarnwerk-{name}-{uuid.uuid4().hex}"
        self.written = 0
        path, files = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.written += 1
        path = f"{self.root}/{self.written:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for df in frames:
            if at := getattr(df, "_kept_at", None):
                path, files = self._files(at)
                files.delete(path, True)


def spread(df: DataFrame, path: str, least_bytes: int = 32 << 20) -> DataFrame:
    """``df``, read from ``path``; a table of less than ``least_bytes`` has few row groups, and tasks, and is
    dealt to all cores. A larger one stays as it is read."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < least_bytes else df


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def whole(df: DataFrame, name: str, kind: str) -> Column:
    """A column cast to its type, or typed nulls if the table lacks it."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


def digest(df: DataFrame) -> Column:
    """A 128-bit digest of the text; null and empty texts differ."""
    return F.coalesce(F.md5(whole(df, "text", "string").cast("binary")), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
