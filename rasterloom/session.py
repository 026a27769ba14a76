"""What operators need from the session: workers that can import this package, and files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the package from where the driver has it (an installed package needs nothing)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir where it is set; one of our own only where driver and executors are one process (tests)."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        sc.setCheckpointDir(top)
    return top


class Files:
    """Small files of any store that Hadoop's file systems reach, from the driver."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(_hadoop(path))
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str, start: int = 0, size: int | None = None) -> bytes:
        """The file, or size bytes (or what there is of them) from start on; nothing else is fetched."""
        fs, p = self._at(path)
        have = fs.getFileStatus(p).getLen() - start
        n = max(0, have if size is None else min(size, have))
        stream = fs.open(p)
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
        finally:
            stream.close()

    def create(self, path: str, data: bytes, overwrite: bool = False) -> bool:
        """Writes a file; without overwrite False if there is one already."""
        from py4j.protocol import Py4JJavaError

        fs, p = self._at(path)
        try:
            out = fs.create(p, overwrite)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or not overwrite and fs.exists(p):
                return False
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return True


def _hadoop(path: str) -> str:
    """s3 URIs by the connector that Hadoop has for them."""
    return "s3a://" + path[5:] if path.startswith("s3://") else path
