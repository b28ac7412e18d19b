"""Tables written to the cluster's shared folder, to cut lineage and to read a costly result twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_unset: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a session with a local master, as in tests, has a
    temporary one; with any other master it is an error, since machines would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _unset:
            _unset.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _unset[0]
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins planned within may leave rows where a part of their keys has dealt them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept_by(df: DataFrame, name: str, column: str, codec: str = "snappy") -> DataFrame:
    """Like ``kept``, in as many buckets of ``column`` as shuffles have partitions: grouping the table by it shuffles nothing, nor
    does joining it with other such tables by ``column`` and more, if the result is kept so too."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    with in_place(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).option("compression", codec).saveAsTable(table)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    found = spark.table(table)
    found.kept_path, found.kept_table = path, table
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` that nothing reads any more."""
    for table in tables:
        if hasattr(table, "kept_table"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.kept_table}")
        files, where = _file_system(table.sparkSession, table.kept_path)
        files.delete(where, True)
