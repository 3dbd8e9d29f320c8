"""The byte decoder against the line-by-line rules, on whole, cut and odd logs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import spans
from millrace.plans import log_queries
from millrace.sources import decoder, log
from tests.test_log import LINES, A, B, MOB, adv, base, hit, stamp

SF = "/root/testdata/sf0.001"
ODD = [
    "", "no stamp", "13:00  NAME,1", "5/21/2024 20:00:00.000 NAME,1", "5/21/2024 20:00:00.000  name,1", "5/21/2024 20:00:00.000  NAME", "5/21/2024 20:00:00.000  NAME,", "5/21/24 20:00:00.000  NAME,1",
    "2/30/2024 20:00:00.000  NAME,1", "5/21/2024 20:00:00.5-330  NAME,1\r", '5/21/2024 20:00:00.000  EMOTE,(a,b),[c,"d"],"x,y",', "5/21/2024 20:00:00.000  SPELL_DAMAGE,[1,2", "5/21/2024 20:00:00.000  UNIT_DIED,a,b,c,d,e,f,g,h,1",
    f"{stamp(1)}  SPELL_HEAL,{base(A, B)},21,\"Mé(n)d, 漢\",0x2,{adv(B)},12.5,400,-150,nil,1", f"{stamp(2)}  SPELL_MISSED,{base(A, MOB)},11,\"Fire\",0x4,ABSORB,nil,99999999999,3", f"{stamp(2)}  SPELL_HEAL_ABSORBED,{base(A, MOB)},11,\"F\",0x4,{A},x,0x1,0x0,51,\"Ward\",0x2,250,900",
    f"{stamp(3)}  SPELL_ENERGIZE,{base(A, B)},21,\"Q\"uote\",0x2,{adv(A)},7.25,+3,0,5", f"{stamp(4)}  SWING_DAMAGE_SUPPORT,{base(A, MOB)},3,\"S\",0x1,{adv(A)},1,1,-1,4,nil,nil,nil,true,nil,nil,{B}", f"{stamp(5)}  SPELL_CAST_SUCCESS,{base(A, MOB)}", f"{stamp(5)}  SPELL_CAST_SUCCESS,{base(A, MOB)},,,",
    f"{stamp(6)}  ENVIRONMENTAL_DAMAGE,{base('0000000000000000', A)},{adv(A)},Slime,120,120,-1,1,0,0,0,nil,nil,nil", f"{stamp(6)}  ENVIRONMENTAL_DAMAGE,{base('0000000000000000', A)},{adv(A)},Sand,120", "12/31 23:59:59.999  ZONE,1", "1/1 00:00:00.000  ZONE,2",
]


def compared(spark, lines, parts=None):
    """The events of (file_id, row, line) by the rules and by the bytes."""
    want = {(r.file_id, r.row): r for r in log.decode(log.tokens(log.numbered(lines))).collect()}
    source = decoder.lines_from_rows(lines) if parts is None else parts
    got = decoder.decoded(source, decoder.settled(decoder.survey(source), True))
    assert got.dtypes == log.decode(log.tokens(lines)).dtypes
    return want, {(r.file_id, r.row): r for r in got.collect()}


def test_equal_on_logs(spark):
    for lines in (LINES, LINES + ODD, ODD, ODD[::-1]):
        want, got = compared(spark, log.rows_from_lines(spark, lines))
        assert got == want
    assert len(want) > 0


def test_equal_on_written_events(spark):
    want, got = compared(spark, log_queries.lines(spark, SF).cache())
    assert got == want and len(got) > 900


def wide(ms, width, slot=2):
    """A hit whose block has another width, and whose overkill has no base amount before it."""
    block = adv(A).split(",")
    block = block[:10] + ["0"] * (width - 19) + block[10:] if width > 19 else block[: width - 19 - 9] + block[-9:]
    amounts = "77,77,5,4,nil,nil,nil,1,nil,nil,ST" if slot == 2 else "77,5,4,nil,nil,nil,1,nil,nil"
    return f"{stamp(ms)}  SPELL_DAMAGE,{base(A, MOB)},11,\"Fire\",0x4,{','.join(block)},{amounts}"


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_equal_however_a_log_is_cut(spark, parts):
    """Calibrations, numbers and years follow the lines before, which other tasks may hold."""
    rng = random.Random(parts)
    bare = [f"{m}/{d} 10:00:00.000  SPELL_CAST_SUCCESS,{base(A, MOB)},61,\"K\",0x1" for m, d in ((11, 3), (12, 30), (12, 31), (1, 1), (2, 29), (5, 5), (4, 1), (4, 2))]
    lines = [f"{stamp(i)}  SPELL_DAMAGE,{base(A, MOB)},11,\"Fire\",0x4,short,1,1" for i in range(20)] + [wide(30, 19, 1), hit(31, A, MOB, 9)] + bare[:4] + [wide(40, 24), wide(41, 19)] + [hit(50 + i, A, MOB, i, crit=rng.choice(["nil", 1])) for i in range(120)] + bare[4:]
    rows = log.rows_from_lines(spark, lines, "a").unionByName(log.rows_from_lines(spark, [wide(1, 25), *lines], "b"))
    cut = decoder.lines_from_rows(rows).withColumn("part", F.floor((F.col("n") - 1) * parts / 200)).repartitionByRange(parts, "file_id", "n").sortWithinPartitions("file_id", "n")
    want, got = compared(spark, rows, cut)
    assert got == want and {r.waste for r in got.values() if r.amount == 77} >= {5}


@pytest.mark.parametrize("size", [1, 7, 20])
def test_equal_however_blocks_are_dealt(spark, size):
    """A task may hold the first and the third block of a file, and another one the second."""
    bare = [f"{m}/{d} 10:00:00.000  SPELL_CAST_SUCCESS,{base(A, MOB)},61,\"K\",0x1" for m, d in ((11, 3), (12, 31), (1, 1), (2, 2), (12, 30), (1, 5), (3, 1), (4, 1))]
    lines = [x for i, b in enumerate(bare) for x in [b] + [hit(10 * i + j, A, MOB, j) for j in range(9)] + ([wide(10 * i + 9, 24)] if i == 5 else [])]
    rows = log.rows_from_lines(spark, lines)
    dealt = decoder.lines_from_rows(rows).repartition(3, F.floor(F.col("n") / size)).sortWithinPartitions("file_id", "n")
    want, got = compared(spark, rows, dealt)
    assert got == want and len(got) == len(lines)


def test_files_are_numbered_over_splits(spark, tmp_path):
    text = [stamp(i) + f"  SPELL_CAST_SUCCESS,{base(A, MOB)},{i},\"K\",0x1" for i in range(400)]
    (tmp_path / "a.txt").write_text("\r\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        source = decoder.lines_of(spark, str(tmp_path))
        runs = decoder.survey(source)
        places = decoder.settled(runs, False)
        rows, parts = decoder.decoded(source, places).orderBy("row").collect(), places.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row, r.spell_id) for r in rows] == [(i + 1, i) for i in range(400)] and parts > 5


def test_numbers_of_spans():
    words = ["12", "-7", "+3x", "", "x", "9223372036854775807", "9223372036854775808", "1.50", "-0.25", "12.", ".5", "3.14159265358979312", "1e5", "nil", "0x1F", "0XZ", "ff", '"a"', '"a', 'a"', '"a"b"', "false", "true", "0", "1"]
    raw = [w.encode() for w in words]
    data, off = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end = off[:-1], off[1:]
    of = lambda vk: [v if k else None for v, k in zip(vk[0].tolist(), vk[1].tolist())]
    assert of(spans.integers(data, start, end)) == [12, -7, 3, None, None, 2**63 - 1, None, 1, 0, 12, None, 3, 1, None, 0, 0, None, None, None, None, None, None, None, 0, 1]
    assert of(spans.floats(data, start, end))[7:12] == [1.5, -0.25, 12.0, None, 3.14159265358979312]
    assert of(spans.hexes(data, start, end))[14:17] == [31, 0, 255]
    assert spans.truths(data, start, end).tolist()[-4:] == [False, True, False, True]
    lo, hi = spans.unquoted(data, start, end)
    assert spans.texts(data, lo, hi).to_pylist()[13:21] == ["", "0x1F", "0XZ", "ff", "a", "a", 'a"', '"a"b"']
    assert spans.texts(data, np.where(np.arange(len(start)) == 1, -1, start), end).to_pylist()[:3] == ["12", None, "+3x"]
    names, place = spans.distinct(data, start, end)
    assert [names[p] for p in place] == words and pa.array(words).to_pylist() == words
