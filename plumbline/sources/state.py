"""What a run leaves for the next one: parsed functions, changes and the cursor, as Parquet.

A run writes a folder of its own and then replaces the pointer, so a failed or interrupted run
leaves the state as it was; one that stops between the pointer's removal and its replacement leaves none.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import shared_dir

VERSION = 1


@dataclass(frozen=True)
class Meta:
    repository: str
    branch: str
    head: str
    patterns: str
    version: int = VERSION


def default_folder(spark: SparkSession, root: str, tool: str) -> str:
    """Within the repository on one machine; on a cluster a folder that all executors share."""
    if spark.sparkContext.master.split("[")[0] == "local":
        return os.path.join(root, f".{tool}")
    return f"{shared_dir(spark)}/../{tool}-{xxhash.xxh3_128_hexdigest(root.encode())}"


class State:
    """``folder`` is a local path or a URI; all of it is read and written by Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
        self.meta: Meta | None = None
        self.at: str | None = None

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def prepare(self) -> None:
        fs, path = self._path()
        if not fs.mkdirs(path):
            raise OSError(f"{self.folder} can't be made")

    def load(self) -> bool:
        """Whether there is a state; raises ValueError on one of another version."""
        fs, pointer = self._path("current.json")
        if not fs.exists(pointer):
            return False
        stream = fs.open(pointer)
        found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if found["meta"]["version"] != VERSION:
            raise ValueError(f"the state has version {found['meta']['version']}")
        self.at, self.meta = found["at"], Meta(**found["meta"])
        return True

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{self.at}/{name}") if self.at else None

    def save(self, meta: Meta, **tables: DataFrame) -> None:
        name = f"run-{uuid.uuid4().hex}"
        for k, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{k}")
        fs, new = self._path(f"current-{name}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"at": name, "meta": asdict(meta)}).encode()))
        out.close()
        _, pointer = self._path("current.json")
        fs.delete(pointer, False)
        if not fs.rename(new, pointer):
            raise OSError("the state's pointer can't be moved")
        if self.at:
            fs.delete(self._path(self.at)[1], True)
