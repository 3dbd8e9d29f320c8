"""The tailing source: appends in any portions give the lines of a batch read."""

import pytest

from millrace.sources import log
from millrace.streaming import tail
from tests.test_log import LINES


def lines_of(reader, start, end):
    return [row for part in reader.partitions(start, end) for row in reader.read(part)]


def test_ranges_share_no_line(tmp_path):
    f = tmp_path / "a.txt"
    f.write_bytes(b"a\r\n\nbc\n" + b"x" * 40 + b"\nd\ntail")
    want = [(0, "a"), (4, "bc"), (7, "x" * 40), (48, "d")]
    for length in range(1, 60):
        reader = tail.TailReader({"path": str(f), "maxBytesPerPartition": str(length)})
        got = lines_of(reader, {}, reader.latestOffset())
        assert [(at, line) for _, at, line in got] == want


def test_portions_equal_batch(tmp_path):
    body = "\r\n".join(LINES).encode() + b"\n"
    for size in (1, 7, 64, 1024):
        f, at, got = tmp_path / f"{size}.txt", {}, []
        f.write_bytes(b"")
        reader = tail.TailReader({"path": str(f), "maxBytesPerPartition": "100"})
        for i in range(0, len(body), size * 37):
            with f.open("ab") as out:
                out.write(body[i : i + size * 37])
            now = reader.latestOffset()
            rows = lines_of(reader, at, now)
            assert lines_of(reader, at, now) == rows  # a lost range is read again
            got, at = got + rows, now
        assert [line for _, _, line in got] == LINES and sorted(r for _, r, _ in got) == [r for _, r, _ in got]


def test_rotation_keeps_rows_apart_though_the_new_log_is_longer(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("one\ntwo\n")
    reader = tail.TailReader({"path": str(tmp_path)})
    at = reader.latestOffset()
    first = lines_of(reader, {}, at)
    f.write_text("another\nlog\nlonger\n")
    second = lines_of(reader, at, reader.latestOffset())
    assert [r[2] for r in first] == ["one", "two"] and [r[2] for r in second] == ["another", "log", "longer"]
    assert len({r[0] for r in first + second}) == 2
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_lines_of_a_log_that_was_moved_or_lost(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("one\ntwo\n")
    reader = tail.TailReader({"path": str(f)})
    at = reader.latestOffset()
    f.rename(tmp_path / "a.old")
    assert [r[2] for r in lines_of(reader, {}, at)] == ["one", "two"]  # found under its new name
    (tmp_path / "a.old").unlink()
    with pytest.raises(tail.LostLines):
        lines_of(reader, {}, at)
    assert lines_of(tail.TailReader({"path": str(f), "failOnDataLoss": "false"}), {}, at) == []
    f.write_text("incomplete")
    assert reader.latestOffset() == {}


def test_live_report(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    f, seen = tmp_path / "logs" / "a.txt", []
    f.write_text("\n".join(LINES[:20]) + "\n")
    q = tail.live(tail.follow(spark, str(tmp_path / "logs")), str(tmp_path / "out"), lambda lines: seen.append(lines.count()), every="0 seconds")
    try:
        q.processAllAvailable()
        with f.open("a") as out:
            out.write("\n".join(LINES[20:]) + "\n")
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen[-1] == len(LINES)
    whole = spark.read.parquet(str(tmp_path / "out" / "lines"))
    stream = log.tokens(whole.select("file_id", "row", "line"))
    assert stream.count() == log.tokens(log.rows_from_lines(spark, LINES)).count()
