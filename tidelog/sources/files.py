"""Small files through Hadoop's file system, so any store that Spark reads will do; the application's working folders."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self._new(self.path(name))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """A whole file under a name that was free; False if it was taken.

        It is written aside, so no reader sees a part, and takes its name in one
        step that fails if another was there: a link on a local file system, a
        rename elsewhere, which HDFS refuses onto a name that exists. Object
        stores whose rename isn't one step need one writer at a time.
        """
        aside = self._at(f"aside-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if self._fs.getScheme() == "file":
                done = self._linked(aside, name)
            else:
                done = not self.exists(name) and self._fs.rename(aside, self._at(name))
        finally:
            self._fs.delete(aside, False)
        return done

    def _linked(self, aside, name: str) -> bool:
        local = lambda p: self._jvm.java.nio.file.Path.of(self._fs.makeQualified(p).toUri())
        try:
            self._jvm.java.nio.file.Files.createLink(local(self._at(name)), local(aside))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed, by this machine's clock."""
        return (self._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(self._at(name)).getModificationTime()) / 1000

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, removed at exit; an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="tidelog-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def work_root(spark: SparkSession) -> str:
    """The folder of all working folders of this application."""
    return f"{shared_dir(spark).rstrip('/')}/tidelog-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI for one run of an operator."""
    return f"{work_root(spark)}/{what}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove the working folders of this application. Results are read from them, so only once these are written elsewhere."""
    Folder(spark, work_root(spark)).remove("")
