"""Durable stages and versions in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="skylattice-"))
        folder = _own[0]
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write and read back: the lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------------------- files


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place as a whole: written beside it and renamed over it through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}", path))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri() if old.toUri().getScheme() else jvm.java.net.URI.create("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parents = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 1)
    parents[0] = getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts").createParent()
    out = files.create(new, flags, parents)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files.rename(new, old, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    size = files.getFileStatus(at).getLen()
    stream = files.open(at)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


class Store:
    """Tables that change together. Each version is a folder with one Parquet table for each name; a file says which
    version is read. A commit writes the new folder first and then swaps the file, so readers see the old version or the new
    one, of all tables, and a writer that dies leaves the old one. Versions stay, and any of them can be restored."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.path}/CURRENT"

    def current(self) -> str | None:
        return read_text(self.spark, self._pointer())

    def versions(self) -> list[str]:
        return [x for x in list_names(self.spark, self.path) if x.startswith("version-")]

    def prepare(self, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> str:
        """Write a version that nobody reads yet. Tables of the current version that are not given are carried on by name."""
        old = self.current()
        version = f"version-{int(old.split('-')[1]) + 1 if old else 0:08d}-{uuid.uuid4().hex[:8]}"
        held = self._tables(old) if old else {}
        for name, df in tables.items():
            by = (order or {}).get(name)
            (df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df).write.parquet(f"{self.path}/{version}/{name}")
            held[name] = f"{version}/{name}"
        write_text(self.spark, f"{self.path}/{version}/TABLES", "\n".join(f"{k}\t{v}" for k, v in sorted(held.items())))
        return version

    def _tables(self, version: str) -> dict[str, str]:
        text = read_text(self.spark, f"{self.path}/{version}/TABLES")
        if text is None:
            raise ValueError(f"no version {version} in {self.path}")
        return dict(line.split("\t") for line in text.splitlines())

    def publish(self, version: str) -> None:
        self._tables(version)
        write_text(self.spark, self._pointer(), version)

    restore = publish

    def commit(self, tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> str:
        version = self.prepare(tables, order)
        self.publish(version)
        return version

    def read(self, name: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise ValueError(f"nothing is published in {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self._tables(version)[name]}")


def bucket(key, buckets: int):
    """A bucket for each key, the same on every run."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
