"""Tables and small files in folders that driver and executors share, by way of Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder's small files, read and written whole by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._spark = path.rstrip("/"), spark
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _at(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)  # noqa: SLF001

    def names(self, inside: str = "") -> list[str]:
        if not self._fs.exists(self._at(inside)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(inside)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, name: str, data: bytes, replace: bool = False) -> None:
        """Whole or not at all: written beside and renamed. Without replace, an existing file is an error, so that of
        two writers of one name only one succeeds."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._at(beside), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if replace:
            self._fs.delete(self._at(name), False)
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(beside), self._at(name)):
            self._fs.delete(self._at(beside), False)
            raise FileExistsError(f"{self.path}/{name}")

    def rename(self, name: str, new: str) -> None:
        if not self._fs.rename(self._at(name), self._at(new)):
            raise FileExistsError(f"{self.path}/{new}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))
