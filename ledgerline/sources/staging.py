"""Folders that the driver and all executors share: settled frames and a bounded cache of results."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where all is one machine."""
    if not (shared := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write df once and go on from what is written, so that several scans of it don't run what it comes from again."""
    path = staging_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """A Hadoop file system, as Spark reaches it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self.path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, path: str):
        return self._paths(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.path(path))

    def list(self, path: str) -> list[tuple[str, int, int]]:
        """(name, modified, bytes) of what a folder holds."""
        return [(s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in self._fs.listStatus(self.path(path))] if self.exists(path) else []

    def status(self, path: str) -> tuple[int, int]:
        s = self._fs.getFileStatus(self.path(path))
        return s.getModificationTime(), s.getLen()

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self.path(old), self.path(new))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self.path(path), True)

    def write(self, path: str, text: str) -> None:
        """The whole text or nothing, under a new name: it is written beside and then takes the name."""
        beside = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self.path(beside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.rename(beside, path):
            self.delete(beside)
            raise OSError(f"cannot write {path}")

    def touch(self, path: str) -> None:
        self._fs.setTimes(self.path(path), int(time.time() * 1000), -1)

    def read(self, spark: SparkSession, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


@contextmanager
def parted(df: DataFrame, most: int) -> Iterator[DataFrame]:
    """df in parts of at most `most` rows, for work that holds whole parts. Where a part has more, df is written without a
    shuffle to files of at most as many rows, each read as a part of its own, and deleted at the end."""
    largest = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        yield df
        return
    spark, path = df.sparkSession, staging_path(df.sparkSession, "parted")
    own = spark._jsparkSession.newSession()  # the caller's settings stay as they are
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key) or not key.startswith("spark."):
            own.conf().set(key, value)
    own.conf().set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))  # no two files share a part
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
        yield DataFrame(own.read().schema(df._jdf.schema()).parquet(path), spark)
    finally:
        Files(spark, path).delete(path)


#: Results that the cache keeps.
MOST = 32


def key_of(df: DataFrame) -> str | None:
    """A name for a result: of the plan without the names that Spark deals out, and of the files it reads, with their sizes
    and times. None where the same plan may give something else: what is random or of now, and sources that aren't files."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic() or any(word in df._jdf.queryExecution().analyzed().toString() for word in ("current_timestamp", "current_date", "now()", "uuid(", "localtimestamp")):
        return None
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    files = sorted(df.inputFiles())
    if not files or not kinds <= {"LogicalRelation"}:
        return None
    told = Files(df.sparkSession, files[0])
    listing = [f"{f} {told.status(f)}" for f in files]
    conf = [f"{k}={df.sparkSession.conf.get(k, None)}" for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")]
    return hashlib.sha256("\n".join([plan.canonicalized().toString(), df.schema.json(), *conf, *listing]).encode()).hexdigest()


def cached(df: DataFrame, folder: str | None = None, most: int = MOST) -> DataFrame:
    """df as it was settled when the same plan over the same files ran last, or settled now. Of more than `most` results
    those unused for longest are deleted. What has no key runs as it is. A result appears under its name all at once."""
    if (key := key_of(df)) is None:
        return df
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/results"
    files, path = Files(spark, folder), f"{folder}/{key}"
    if not files.exists(f"{path}/_SUCCESS"):
        beside = f"{folder}/_new-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(beside)
        if not files.rename(beside, path):  # another one was faster
            files.delete(beside)
    files.touch(path)
    held = sorted((modified, name) for name, modified, _ in files.list(folder) if not name.startswith("_"))
    for _, name in held[: max(0, len(held) - most)]:
        files.delete(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(path)
