"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that are safe on any cluster.  Resource sizes belong to the
#: deployment and are not set here.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "siftloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Without that setting a temporary folder is used, and only by a local master, whose
    executors are this process; a cluster must name the folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not is_local(spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def is_local(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Folders of ``scratch_folder``, ``cut_lineage`` and ``write_bucketed`` not removed yet, and the tables over some of them.
_WRITTEN: list[str] = []
_TABLES: list[str] = []


def remove_intermediate(spark: SparkSession) -> int:
    """Delete what ``cut_lineage`` wrote; call it when results that read it are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    count = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += path.getFileSystem(conf).delete(path, True)
    return count


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the other intermediate data."""
    path = f"{shared_folder(spark)}/siftloom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The rows are computed once, the plan restarts from files, and lost executors
    re-read instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siftloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, key: str, buckets: int, table: str | None = None, partition: str | None = None) -> str:
    """Write ``df`` to a table in the shared folder, bucketed and sorted by ``key``; append if ``table`` is named.

    Joins on the key then read the buckets as they are, without a shuffle.
    """
    spark = df.sparkSession
    name = table or f"siftloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    writer = df.repartition(buckets, key).write.format("parquet").mode("append").bucketBy(buckets, key).sortBy(key).option("path", path)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    if table is None:
        _WRITTEN.append(path)
        _TABLES.append(name)
    return name
