"""Following growing logs: a streaming source of appended lines and live totals over it.

Spark's file stream sees new files, not appends. This Python data source's offset holds, for each file, how far its
complete lines reach. The driver looks at sizes, first lines and last line ends alone; the bytes between two offsets are
cut into ranges that executors read, so a range of a lost one is read again and a long backlog is read in many tasks.
Only local or mounted folders that driver and executors share can be followed; batch reading (``sources.log``) takes any
file system.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "file_id string, row long, line string"
CHUNK = 1 << 20


def line_mark(path: str) -> str | None:
    """What tells a log from the one that took its place: a checksum of its first line; None while that is incomplete."""
    with open(path, "rb") as f:
        first = f.readline()
    return f"{zlib.crc32(first):08x}" if first.endswith(b"\n") else None


def lines_end(path: str) -> int:
    """Where the last complete line ends, found from the end of the file backwards."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            lo = max(0, at - CHUNK)
            f.seek(lo)
            cut = f.read(at - lo).rfind(b"\n")
            if cut >= 0:
                return lo + cut + 1
            at = lo
    return 0


def lines_between(path: str, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the non-empty complete lines that begin in [lo, hi); CR at line ends goes. Ranges that meet share no line."""
    with open(path, "rb") as f:
        at = lo
        if lo > 0:  # the line that the byte before the range lies in begins before it
            f.seek(lo - 1)
            at += len(f.readline()) - 1
        while at < hi and (raw := f.readline()).endswith(b"\n"):
            text = raw[:-1].removesuffix(b"\r").decode("utf-8", "replace")
            if text:
                yield at, text
            at += len(raw)


@dataclass
class Range(InputPartition):
    path: str
    mark: str
    lo: int
    hi: int


class LostLines(RuntimeError):
    """A log was replaced before its planned lines were read."""


class TailReader(DataSourceStreamReader):
    """Appended lines of the files ``path`` (a file or a folder's ``*.txt``); row is the line's byte offset.

    A file is named by its path and its first line's mark: a log that takes another's place begins with another stamp,
    so it is read from its start and its rows stay apart. A log that was cut short goes on where it grows beyond its
    offset. A range whose log is gone raises ``LostLines``; with ``failOnDataLoss`` false it is passed over. Empty files
    and files without a complete line wait. ``maxBytesPerPartition`` is the length of a range; one line is held at a time.
    """

    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("maxBytesPerPartition", 32 << 20))
        self.strict = options.get("failOnDataLoss", "true").lower() != "false"

    def _files(self) -> list[str]:
        p = Path(self.path)
        return [str(p)] if p.is_file() else sorted(str(f) for f in p.glob("*.txt"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        now = {}
        for f in self._files():
            try:
                mark, end = line_mark(f), lines_end(f)
            except FileNotFoundError:  # moved away since it was listed
                continue
            if mark:
                now[f] = {"mark": mark, "end": end}
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for f, to in end.items():
            was = start.get(f)
            at = was["end"] if was and was["mark"] == to["mark"] else 0
            out += [Range(f, to["mark"], lo, min(lo + self.length, to["end"])) for lo in range(at, to["end"], self.length)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        found = partition.path if os.path.exists(partition.path) and line_mark(partition.path) == partition.mark else self._moved(partition)
        if found is None or os.path.getsize(found) < partition.hi:
            if self.strict:
                raise LostLines(f"{partition.path} was replaced or cut before bytes {partition.lo} to {partition.hi} were read")
            return
        name = f"{partition.path}#{partition.mark}"
        for at, line in lines_between(found, partition.lo, partition.hi):
            yield name, at, line

    @staticmethod
    def _moved(partition: Range) -> str | None:
        """The log under the name that a rotation gave it, in the same folder."""
        for other in sorted(glob.glob(os.path.join(glob.escape(os.path.dirname(partition.path)), "*"))):
            if os.path.isfile(other) and line_mark(other) == partition.mark:
                return other
        return None

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options)


def follow(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (file_id, row, line)."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").options(path=path, **options).load()


def live(stream: DataFrame, folder: str, report, *, every: str = "1500 milliseconds") -> StreamingQuery:
    """Appends the lines to a table and runs ``report(lines)`` over all of it after each batch, at most so often.

    The lines are written once per batch under the batch's number, so a batch that is run again replaces itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")
        report(batch.sparkSession.read.parquet(f"{folder}/lines").select("file_id", "row", "line"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()


def live_counts(stream: DataFrame) -> DataFrame:
    """Lines per event name so far, for the update mode."""
    return stream.select(F.regexp_extract("line", r"^\S+ \S+  ([A-Z_0-9]+)", 1).alias("name")).filter("name <> ''").groupBy("name").count()
