"""Tables written to the shared folder in the middle of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of sessions for which no shared one is named, by application.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named and all tasks run on this machine (tests), one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    if not root:
        root = _own.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='terrier-')}"
        _own[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/terrier-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and losing an executor loses none of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table made by written() that nothing reads any more."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
