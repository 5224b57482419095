"""Tables kept between the steps of an iterative plan.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading
it back.  Every executor sees that folder, so a lost executor costs no more
than the step that was running, and the table is columnar (a later step reads
only the columns that it uses).
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names.

    Only a local session, whose tasks all run on this machine, gets a temporary
    one if it names none; it goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set; executors under {master} need a folder that all of them see")
        path = tempfile.mkdtemp(prefix="ridgeline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = "file://" + path
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Writes tables of one run; ``drop`` frees those that no one reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self._paths.pop(id(df), None)
        if path is None:
            return
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
