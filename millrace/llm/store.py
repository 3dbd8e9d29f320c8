"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back,
so a lost executor costs a re-read and not a recomputation. Only where that setting is absent
(tests, a local session) a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; a temporary folder only if a local session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
    return f"file://{_LOCAL[0]}"


class Workspace:
    """Named intermediate tables of one operator run; ``drop`` frees one as soon as it is spent."""

    _scopes: list[list["Workspace"]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)
        for scope in self._scopes[-1:]:
            scope.append(self)

    @classmethod
    @contextmanager
    def scope(cls) -> Iterator[None]:
        """Frees, at its end, all tables of the workspaces made within: for a step whose result is by then written."""
        cls._scopes.append([])
        try:
            yield
        finally:
            for space in cls._scopes.pop():
                space.close()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
        """Write ``df`` as table ``name``, with further options of the writer, and return the table."""
        df.write.mode("overwrite").options(compression=codec, **options).parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass

    def _delete(self, uri: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(uri)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
