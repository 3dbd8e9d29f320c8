"""Session settings and table access shared by tests, bench and queries."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster pass your own session to the operators instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{n}]",
        "spark.app.name": app,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet table ``name`` and read back: the next steps start from a plain scan."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; of this machine only in a local
    session without it. It is deleted when the driver's Python ends, or by ``discard`` before."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{at.rstrip('/')}/millrace-{uuid.uuid4().hex}" if at else f"file://{tempfile.mkdtemp(prefix='millrace-')}"
    atexit.register(_discard_at_exit, spark, folder)
    return folder


def _discard_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        discard(spark, folder)
    except Exception:  # noqa: BLE001  the session may be gone by then
        pass


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``scratch`` named, with all its tables; nothing happens if it is gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: equal as long as the table was not written anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = system.listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return "\n".join(sorted(found))
