"""Tables written to the folder that all executors share.

Iterative operators cut their lineage here. A written Parquet table outlives
any executor, is columnar and compressed, and is dropped as soon as no later
step reads it; what an operator's result still reads is dropped when the session
ends. The folder is ``spark.checkpoint.dir`` of the session; where that is unset,
a temporary folder serves sessions whose executors are this process alone, and
on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session, without trailing slash; ValueError on a cluster that names none."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of any file system that the session knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, else not before the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@atexit.register
def _delete_open() -> None:
    for root, spark in _OPEN.items():
        with contextlib.suppress(Exception):
            delete(spark, root)


class Scratch:
    """A folder of written tables that belongs to one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _OPEN[self.root] = spark

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written table.

        The written schema is passed on, so no job is run to infer it and an
        empty table keeps its columns.
        """
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the operator's result reads."""
        self.drop(*(self.names - set(names)))

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write an operator's result and delete all that it was made from."""
        written = self.write(df, name)
        self.keep(name)
        return written
