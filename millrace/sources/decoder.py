"""The fast decoder: log lines to typed events by numpy over the bytes of Arrow batches.

Two scans of the lines, in which no text is shuffled or sorted:

* ``survey`` tells, for every run of lines of a file that a task meets, what a later line may depend on: how
  many lines there are, the first line that shows the width of the optional block, the first that shows the
  overkill slot, the months at both ends and where they fell. It also passes the few control lines on. The
  runs' summaries are merged in file order (``settled``): one row a run, a millionth of the log.
* ``decoded`` reads every line with what its file's lines before it have shown: field offsets from the places of
  commas outside quotes, numbers from digits, and columns of texts cut from the buffer.

The events equal those of ``log.decode(log.tokens(...))``, which states the same rules line by line as expressions.
Lines with brackets outside quotes (few, and most of them control lines) are split by the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window as W

from millrace.functions import spans
from millrace.functions.text import FIELD
from millrace.functions.times import STAMP, with_few
from millrace.sources import log

BATCH_BYTES = 8 << 20
LEAP_YEAR = 2024  # any: all dates exist in it
HEAD = 40  # bytes that a stamp and the two blanks after it fit into
_FIELD, _STAMP, _DOTTED, _GUID, _NAME = re.compile(FIELD), re.compile(STAMP), re.compile(r"-?[0-9]+\.[0-9]+"), re.compile(log.GUID), re.compile(r"[A-Z_0-9]+")
GUIDS = tuple(x.encode() + b"-" for x in ("Player", "Creature", "Pet", "Vehicle", "GameObject", "Vignette", "Item", "Corpse", "BattlePet", "ClientActor"))
RUN = "file_id string, part long, n long, lines long, width_n long, width int, slots array<struct<width:int,n:long,slot:int>>, falls array<long>, first_month int, last_month int, line string"
PLACE = "file_id string, part long, first long, base long, width_row long, width int, slot_row long, slot int, falls array<long>"


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_id, part, n, line) of the files at ``path``: n orders the lines of a part, parts follow each other in the file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def lines_from_rows(lines: DataFrame) -> DataFrame:
    """The same shape from (file_id, row, line)."""
    return lines.select("file_id", F.lit(0).cast("long").alias("part"), F.col("row").alias("n"), "line")


def _batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` over batches of about BATCH_BYTES (the session's Arrow setting is read when a job starts)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at = df.sparkSession.conf.get(name).rstrip("b")
    if not (at.isdigit() and 0 < int(at) <= BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    return df.mapInArrow(fn, schema)


# stamps


@lru_cache(maxsize=4096)
def _shape(text: bytes) -> tuple[tuple[int, int] | None, ...] | None:
    """The places of a stamp's parts in all stamps whose digits stand where this one's do; None for a bad stamp."""
    m = _STAMP.fullmatch(text.decode("latin-1"))
    return tuple(m.span(i) if m.group(i) is not None else None for i in range(1, 9)) if m else None


@dataclass
class Lines:
    """The well-formed lines of one batch: those with a stamp, two blanks and a name.

    ``at`` are their places in the batch; ``name`` and ``end`` where the name begins and the line ends, ``stop`` where
    the name does; ``names`` and ``which`` the names; ``month`` ... the stamps' parts, years -1 where there is none.
    """

    data: np.ndarray
    at: np.ndarray
    end: np.ndarray
    name: np.ndarray
    stop: np.ndarray
    names: list[str]
    which: np.ndarray
    month: np.ndarray
    day: np.ndarray
    year: np.ndarray
    day_ms: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Lines":
        data, off = spans.buffer_of(column)
        start, end = off[:-1], off[1:].copy()
        end -= (end > start) & (spans.byte_at(data, end - 1, end) == 13)
        padded = np.concatenate([data, np.zeros(HEAD + 1, dtype=np.uint8)])
        head = np.lib.stride_tricks.sliding_window_view(padded, HEAD + 1)[start] if len(start) else np.zeros((0, HEAD + 1), dtype=np.uint8)
        gap = (head[:, :-1] == 32) & (head[:, 1:] == 32)
        size = gap.argmax(axis=1)
        ok = gap.any(axis=1) & (start + size + 2 < end)
        at = np.flatnonzero(ok)
        size, head = size[at], head[at]
        # stamps of one shape have their digits in the same places
        form = np.where((head >= 48) & (head <= 57), 48, head)
        form[np.arange(HEAD + 1) >= size[:, None]] = 0
        weight = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, HEAD + 1, dtype=np.uint64)
        _, first, shape = np.unique((form * weight).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
        parts = np.full((len(at), 8), -1, dtype=np.int64)
        good = np.zeros(len(at), dtype=bool)
        for k, f in enumerate(first):
            places, rows = _shape(form[f, : size[f]].tobytes()), np.flatnonzero(shape == k)
            if places is None:
                continue
            good[rows] = True
            for p, place in enumerate(places[:7]):
                if place:
                    digits = head[rows, place[0] : place[1]].astype(np.int64) - 48
                    parts[rows, p] = digits @ 10 ** np.arange(place[1] - place[0])[::-1]
                    if p == 6:  # a fraction of fewer digits is filled from the right
                        parts[rows, p] *= 10 ** (3 - (place[1] - place[0]))
        keep = np.flatnonzero(good)
        at, parts, size = at[keep], parts[keep], size[keep]
        name, end = start[at] + size + 2, end[at]
        commas = np.flatnonzero(data == 44)
        next_ = np.append(commas, len(data))[np.searchsorted(commas, name)]
        stop = np.minimum(next_, end)
        names, which = spans.distinct(data, name, stop)
        named = np.array([_NAME.fullmatch(x) is not None for x in names], dtype=bool)
        keep = np.flatnonzero(named[which]) if len(names) else np.zeros(0, dtype=np.int64)
        at, end, name, stop, which, parts = at[keep], end[keep], name[keep], stop[keep], which[keep], parts[keep]
        day_ms = ((parts[:, 3] * 60 + parts[:, 4]) * 60 + parts[:, 5]) * 1000 + np.maximum(parts[:, 6], 0)
        return cls(data, at, end, name, stop, names, which, parts[:, 0], parts[:, 1], parts[:, 2], day_ms)

    def text(self, i: int) -> str:
        """From the name on."""
        return self.data[self.name[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def wall_ms(lines: Lines, rolls: np.ndarray, assumed_year: int) -> tuple[np.ndarray, np.ndarray]:
    """(local wall clock in ms, whether the date exists): years of bare stamps are the assumed one plus the rolls before them."""
    year = np.where(lines.year >= 0, lines.year, assumed_year + rolls)
    key = (year * 13 + lines.month) * 32 + lines.day
    keys, place = np.unique(key, return_inverse=True)
    days, known = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    for i, k in enumerate(keys.tolist()):
        try:
            days[i], known[i] = (date(k // 32 // 13, k // 32 % 13, k % 32) - date(1970, 1, 1)).days, True
        except ValueError:
            pass
    return days[place] * 86_400_000 + lines.day_ms if len(keys) else np.zeros(0, dtype=np.int64), known[place] if len(keys) else np.zeros(0, dtype=bool)


# one line, as plain Python: for the few lines that a file's calibration is read from


def _fields(body: str) -> list[str]:
    found = [m.group(1) for m in _FIELD.finditer(body)]
    return found[:-1]


@lru_cache(maxsize=4096)
def _kind(name: str) -> tuple[str, bool, int]:
    """(code, support, fields between the sides and the block) of an event name."""
    support = name.endswith("_SUPPORT")
    code = name.removesuffix("_SUPPORT")
    if code.startswith("SWING"):
        return code, support, 3 if support else 0
    return code, support, 0 if code.startswith(("ENVIRONMENTAL", "UNIT")) or code == "PARTY_KILL" else 3


def _block(f: list[str], name: str) -> int | None:
    """Where a line's optional block starts."""
    code, _, prefix = _kind(name)
    start = log.BASE + prefix
    there = len(f) > start + log.MIN_WIDTH and code not in ("SPELL_ABSORBED", "SPELL_HEAL_ABSORBED") and _GUID.search(f[start])
    return start if there else None


def _width(f: list[str], name: str) -> int | None:
    """The width that a line shows."""
    adv = _block(f, name)
    if adv is None:
        return None
    seen = next((i + 5 for i, x in enumerate(f[adv:]) if _DOTTED.fullmatch(x)), None)
    return seen if seen is not None and log.MIN_WIDTH <= seen <= log.MAX_WIDTH else None


def _slot(f: list[str], name: str, width: int) -> int | None:
    """The overkill slot that a damage line shows under a width."""
    code, support, prefix = _kind(name)
    if code not in log.DAMAGE or len(f) < log.BASE + prefix:
        return None
    adv = _block(f, name)
    at = (log.BASE + prefix if adv is None else adv + width) + (code == "ENVIRONMENTAL_DAMAGE")
    n, get = len(f) - at - support, lambda i: f[i] if 0 <= i < len(f) else None
    return 2 if n >= 11 else 1 if n <= 9 or get(at + 1) == "-1" else 2 if get(at + 2) == "-1" else None


# the first scan


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lines are of one file and part and follow each other: none can lie between another's."""
    n = batch.num_rows
    file, part, order = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2))
    code = np.asarray(file.dictionary_encode().indices)
    cut = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (order[1:] != order[:-1] + 1)) + 1
    for a, b in zip([0, *cut], [*cut, n]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def survey(lines: DataFrame) -> DataFrame:
    """Summaries (line null) of runs of lines, and the control lines."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for run in _runs(batch) for row in _summary(run)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RUN)

    return _batches(lines, scan, RUN)


_SLOT = pa.struct([("width", pa.int32()), ("n", pa.int64()), ("slot", pa.int32())])
_ARROW_RUN = pa.schema([
    ("file_id", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("lines", pa.int64()), ("width_n", pa.int64()), ("width", pa.int32()), ("slots", pa.list_(_SLOT)),
    ("falls", pa.list_(pa.int64())), ("first_month", pa.int32()), ("last_month", pa.int32()), ("line", pa.string()),
])


def _summary(run: pa.RecordBatch) -> Iterator[dict]:
    file, part = run.column(0)[0].as_py(), run.column(1)[0].as_py()
    order, found = np.asarray(run.column(2)), Lines.of(run.column(3))
    n = order[found.at]
    base = {"file_id": file, "part": part}
    control = np.array([x in log.CONTROL for x in found.names], dtype=bool)
    damage = np.array([_kind(x)[0] in log.DAMAGE for x in found.names], dtype=bool)
    is_control = control[found.which] if len(control) else np.zeros(0, dtype=bool)
    for i in np.flatnonzero(is_control):
        yield base | {"n": int(n[i]), "line": run.column(3)[int(found.at[i])].as_py()}
    if len(n):  # the run's last time may end a run of the log; its line is told as well
        ms, real = wall_ms(found, np.cumsum(np.append(False, found.month[1:] < found.month[:-1])), LEAP_YEAR)
        last = int(np.where(real, ms, np.iinfo(np.int64).min).argmax())
        if not is_control[last]:
            yield base | {"n": int(n[last]), "line": run.column(3)[int(found.at[last])].as_py()}
    commas = np.concatenate([[0], np.cumsum(found.data == 44)])
    fields = commas[found.end] - commas[found.stop]  # no fewer than there are
    parse = lambda i: (_fields(found.text(i).partition(",")[2]), found.names[found.which[i]])
    width_n = width = None
    for i in np.flatnonzero(~is_control & (fields > log.BASE + log.MIN_WIDTH)):
        seen = _width(*parse(i))
        if seen is not None:
            width_n, width = int(n[i]), seen
            break
    # the first slot by the default width, and by the width that this run shows
    slots, blows = [], np.flatnonzero(damage[found.which]) if len(damage) else []
    for w in {log.DEFAULT_WIDTH, width or log.DEFAULT_WIDTH}:
        for i in blows:
            slot = _slot(*parse(i), w)
            if slot is not None and (w == log.DEFAULT_WIDTH or n[i] >= width_n):
                slots.append({"width": w, "n": int(n[i]), "slot": slot})
                break
    bare = np.flatnonzero(found.year < 0)
    month = found.month[bare]
    falls = n[bare[1:][month[1:] < month[:-1]]]
    yield base | {
        "n": int(order[0]), "lines": len(order), "width_n": width_n, "width": width, "slots": slots, "falls": falls.tolist(),
        "first_month": int(month[0]) if len(month) else None, "last_month": int(month[-1]) if len(month) else None,
    }


def settled(runs: DataFrame, numbered: bool) -> DataFrame:
    """(file_id, part, first, base, ...): where each part's rows begin, and from which row on a file's calibrations hold.

    A line's row is n - first + base. ``numbered``: n is the row already. A file's runs are merged in order by one task: they
    are a millionth of its lines.
    """

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["part", "n"])
        first = found.groupby("part")["n"].min()
        lines = found.groupby("part")["lines"].sum().sort_index()
        base = lines.cumsum() - lines + 1
        row = (lambda part, n: n) if numbered else (lambda part, n: n - first[part] + base[part])
        at = width = slot_row = slot = None
        falls, month = [], None
        for r in found.itertuples():
            if width is None and not pd.isna(r.width):
                at, width = row(r.part, r.width_n), int(r.width)
            for s in sorted(r.slots, key=lambda s: s["n"]) if slot is None else ():
                here = row(r.part, s["n"])
                if slot is None and s["width"] == (width if width is not None and here >= at else log.DEFAULT_WIDTH):
                    slot_row, slot = here, s["slot"]
            if not pd.isna(r.first_month):
                if month is not None and r.first_month < month:
                    falls.append(row(r.part, r.n))
                falls += [row(r.part, n) for n in r.falls]
                month = r.last_month
        return pd.DataFrame([{
            "file_id": found["file_id"].iloc[0], "part": p, "first": 0 if numbered else int(first[p]), "base": 0 if numbered else int(base[p]),
            "width_row": at, "width": width, "slot_row": slot_row, "slot": slot, "falls": [int(f) for f in falls],
        } for p in lines.index]).astype({"width_row": "Int64", "width": "Int32", "slot_row": "Int64", "slot": "Int32"})

    found = runs.filter("line IS NULL").groupBy("file_id").applyInPandas(merge, PLACE)
    # rows are told apart over all files: the file's place in the order of names, from 0, in the upper bits
    high = F.shiftleft("_file", log.FILE_BITS)
    found = found.withColumn("_file", (F.dense_rank().over(W.orderBy("file_id")) - 1).cast("long"))  # a row a part
    return found.withColumns({"base": F.col("base") + high, "width_row": F.col("width_row") + high, "slot_row": F.col("slot_row") + high, "falls": F.transform("falls", lambda r: r + high)}).drop("_file")


def placed(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Lines with ``row`` and what ``places`` tells of their part. Parts are few: their table is broadcast up to a checked size."""
    return with_few(lines, places, ["file_id", "part"]).withColumn("row", F.col("n") - F.col("first") + F.col("base"))


def told_lines(runs: DataFrame, places: DataFrame, assumed_year: int = 2024) -> DataFrame:
    """The tokens of a log's control lines, and of each run's last line by its clock."""
    falls = places.select("file_id", F.when(F.size("falls") > 0, F.col("falls")).alias("_falls")).filter("_falls IS NOT NULL").dropDuplicates(["file_id"])
    lines = placed(runs.filter("line IS NOT NULL").select("file_id", "part", "n", "line"), places)
    return log.tokens(lines.select("file_id", "row", F.regexp_replace("line", "\r$", "").alias("line")), assumed_year, falls)


# the second scan


class _Events:
    """Decoded columns of the events among some lines."""

    def __init__(self, lines: Lines, row: np.ndarray, wall: np.ndarray, width: np.ndarray, slot: np.ndarray):
        d, kinds = lines.data, [_kind(x) for x in lines.names]
        of = lambda values, dtype: np.array(values, dtype=dtype)[lines.which] if len(kinds) else np.zeros(0, dtype=dtype)
        prefix, support = of([k[2] for k in kinds], np.int64), of([k[1] for k in kinds], bool)
        group = lambda names: of([k[0] in names for k in kinds], bool)
        self.quotes = spans.count_before(d, 34)
        ptr, fs, fe = _field_spans(lines, self.quotes)
        n = np.diff(ptr)
        keep = np.flatnonzero(~of([x in log.CONTROL for x in lines.names], bool) & (n >= log.BASE + prefix))
        self.data, self.ptr, self.fs, self.fe, self.n = d, ptr[:-1][keep], fs, fe, n[keep]
        self.keep, self.row, self.wall = keep, row[keep], wall[keep]
        self.prefix, self.support, self.width, self.slot = prefix[keep], support[keep], width[keep], slot[keep]
        self.code = pa.array(np.array([k[0] for k in kinds], dtype=object)[lines.which[keep]] if len(kinds) else [], pa.string())
        self.group = lambda *names: group(names)[keep]

    def field(self, i: np.ndarray | int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of field i (from 0) of each event; null beyond its fields and where ``where`` is not."""
        i = np.broadcast_to(np.asarray(i, dtype=np.int64), self.n.shape)
        ok = (i >= 0) & (i < self.n)
        if where is not None:
            ok = ok & where
        at = np.where(ok, self.ptr + i, 0)
        if not len(self.fs):
            return np.full(len(ok), -1), np.full(len(ok), -1)
        return np.where(ok, self.fs[at], -1), np.where(ok, self.fe[at], -1)

    def guid(self, i, where=None) -> pa.Array:
        start, end = self.field(i, where)
        none = spans.equals(self.data, start, end, log.NIL_GUID.encode()) | spans.equals(self.data, start, end, b"nil") | (start == end)
        return spans.texts(self.data, np.where(none, -1, start), end)

    def raw(self, i, where=None) -> pa.Array:
        return spans.texts(self.data, *self.field(i, where))

    def text(self, i, where=None) -> pa.Array:
        start, end = self.field(i, where)
        lo, hi = spans.unquoted(self.data, start, end, self.quotes)
        return spans.texts(self.data, np.where(start < 0, -1, lo), np.where(start < 0, -1, hi))

    def whole(self, i, where=None) -> tuple[np.ndarray, np.ndarray]:
        return spans.integers(self.data, *self.field(i, where))

    def number(self, i, where=None) -> tuple[np.ndarray, np.ndarray]:
        return spans.floats(self.data, *self.field(i, where))

    def true(self, i, where=None) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.field(i, where)
        return spans.truths(self.data, start, end), start >= 0


def _field_spans(lines: Lines, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, start, end): line r has the fields ptr[r]:ptr[r+1]. Commas in quotes or brackets do not split."""
    d, n = lines.data, len(lines.at)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def within(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, line, whether outside quotes) of those places that are in the fields of a line."""
        lo, hi = np.searchsorted(at, lines.stop), np.searchsorted(at, lines.end)
        size = hi - lo
        line = np.repeat(np.arange(n), size)
        at = at[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return at, line, (quotes[at] - quotes[lines.stop][line]) % 2 == 0

    _, line, outside = within(np.flatnonzero((d == 91) | (d == 40)))
    nested = np.zeros(n, dtype=bool)
    nested[line[outside]] = True
    comma, line, outside = within(np.flatnonzero(d == 44))
    ok = outside & ~nested[line]
    comma, line = comma[ok], line[ok]
    # a field starts after each comma and ends at the next one or the line's end; an empty one at the end does not count
    start = comma + 1
    end = np.append(comma[1:], 0)
    final = np.append(line[1:] != line[:-1], True)[: len(line)]
    end[final] = lines.end[line[final]]
    ok = ~(final & (start == end))
    start, end, line = start[ok], end[ok], line[ok]
    odd = np.flatnonzero(nested)
    if len(odd):
        extra = ([], [], [])
        for i in odd:
            body = d[lines.stop[i] + 1 : lines.end[i]].tobytes().decode("latin-1")  # a code point a byte: places are bytes
            for m in list(_FIELD.finditer(body))[:-1]:
                for column, x in zip(extra, (lines.stop[i] + 1 + m.start(1), lines.stop[i] + 1 + m.end(1), i)):
                    column.append(x)
        start, end, line = (np.concatenate([a, np.array(b, dtype=np.int64)]) for a, b in zip((start, end, line), extra))
        order = np.argsort(line, kind="stable")
        start, end, line = start[order], end[order], line[order]
    ptr = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(line, minlength=n), out=ptr[1:])
    return ptr, start, end


def _any(*choices: tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) of the first choice whose condition holds."""
    value, known, open_ = np.zeros_like(choices[0][1][0]), np.zeros(len(choices[0][0]), dtype=bool), np.ones(len(choices[0][0]), dtype=bool)
    for where, (v, k) in choices:
        take = open_ & where
        value[take], known[take] = v[take], k[take]
        open_ &= ~where
    return value, known


def _pick(*choices: tuple[np.ndarray, np.ndarray | int]) -> np.ndarray:
    """The field number of the first choice whose condition holds, -1 without one."""
    out, open_ = np.full(len(choices[0][0]), -1, dtype=np.int64), np.ones(len(choices[0][0]), dtype=bool)
    for where, i in choices:
        take = open_ & where
        out[take] = np.broadcast_to(i, out.shape)[take]
        open_ &= ~where
    return out


def _columns(e: _Events) -> dict[str, pa.Array]:
    """The event columns, by the rules of ``log.decode``."""
    made = lambda vk, kind: pa.array(vk[0], kind, mask=~vk[1])
    start = log.BASE + e.prefix
    first = e.field(start)
    known = np.zeros(len(e.n), dtype=bool)
    for p in GUIDS:
        known |= spans.equals(e.data, *first, p, whole=False)
    known |= spans.equals(e.data, *first, log.NIL_GUID.encode())
    adv = known & (e.n > start + log.MIN_WIDTH) & ~e.group("SPELL_ABSORBED", "SPELL_HEAL_ABSORBED")
    fall = e.group("ENVIRONMENTAL_DAMAGE")
    at = np.where(adv, start + e.width, start) + fall
    dmg, heal, miss, aura, extra, soak = e.group(*log.DAMAGE), e.group(*log.HEAL), e.group(*log.MISS), e.group(*log.AURA), e.group(*log.EXTRA), e.group("SPELL_ABSORBED")
    drain, power = e.group("SPELL_HEAL_ABSORBED"), e.group(*log.ENERGIZE)
    end = lambda k: e.n - k - e.support
    tail = lambda k: start + e.width - k
    spelled = e.prefix == 3
    kind = _pick((aura, at), (extra, at + 3))
    kind_at = e.field(kind)
    environment = e.field(at - 1, fall)
    names, place = spans.distinct(e.data, np.where(environment[0] < 0, 0, environment[0]), np.where(environment[0] < 0, 0, environment[1]))
    numbers = np.array([1 + log.ENVIRONMENT.index(x.upper()) if x.upper() in log.ENVIRONMENT else 0 for x in names] or [0], dtype=np.int32)
    (current, has), (top, has_top), (left, has_left) = e.whole(tail(9), adv), e.whole(tail(7), adv), e.whole(tail(8), adv)
    mana_known = has & (current == 0) & has_top & (top > 0) & has_left
    mana = np.clip(np.floor(100 * left / np.where(mana_known, top, 1) + 0.5), 0, 100).astype(np.int64)
    spell, spell_known = e.whole(log.BASE, spelled)
    spell_known |= ~spelled
    waste_at = _pick((dmg | heal, at + e.slot), (power, at + 1))
    crit, crit_known = e.true(_pick((dmg, at + e.slot + 5), (heal, at + e.slot + 2), (soak, end(1))))
    died = e.group("UNIT_DIED")
    avoided = np.zeros(len(e.n), dtype=bool)
    for x in log.AVOIDED:
        avoided |= spans.equals(e.data, *e.field(at, miss), x.encode())
    flags = lambda i: made(spans.hexes(e.data, *e.field(i)), pa.int64())
    return {
        "row": pa.array(e.row, pa.int64()), "wall_ms": pa.array(e.wall, pa.int64()), "code": e.code, "support": pa.array(e.support),
        "src": e.guid(0), "src_name": e.text(1), "src_flags": flags(2), "dst": e.guid(4), "dst_name": e.text(5), "dst_flags": flags(6),
        "spell_id": made((spell, spell_known), pa.int64()), "spell": e.text(log.BASE + 1, spelled),
        "extra_spell_id": made(e.whole(_pick((extra, at), (soak, end(6)), (drain, end(4)))), pa.int64()), "extra_spell": e.text(_pick((extra, at + 1), (soak, end(5)), (drain, end(3)))),
        "amount": made(e.number(_pick((dmg | heal, at), (soak, end(3)), (drain, end(1)), (power, at), (miss, at + 2))), pa.float64()), "waste": made(e.whole(waste_at), pa.int64()),
        "absorbed": made(e.whole(_pick((dmg, at + e.slot + 4), (heal, at + e.slot + 1))), pa.int64()), "crit": pa.array(crit & crit_known),
        "buff": pa.array(spans.equals(e.data, *kind_at, b"BUFF"), mask=kind_at[0] < 0), "shield_off": pa.array(e.whole(at + 1, aura)[1], mask=~aura), "miss": e.raw(at, miss), "avoided": pa.array(avoided, mask=e.field(at, miss)[0] < 0),
        "caster": e.guid(_pick((soak, end(10)), (drain, end(8)))), "caster_name": e.text(_pick((soak, end(9)), (drain, end(7)))),
        "environment": spans.texts(e.data, *environment), "environment_kind": pa.array(numbers[place] if len(place) else np.zeros(0, dtype=np.int32), pa.int32(), mask=~fall),
        "feigned": pa.array(e.true(log.BASE)[0], mask=~died), "supporter": e.guid(e.n - 1, e.support), "subject": e.guid(start, adv), "owner": e.guid(start + 1, adv),
        "hp": made(e.whole(start + 2, adv), pa.int64()), "hp_max": made(e.whole(start + 3, adv), pa.int64()), "x": made(e.number(tail(5), adv), pa.float64()), "y": made(e.number(tail(4), adv), pa.float64()),
        "map": made(e.whole(tail(3), adv), pa.int64()), "mana": pa.array(mana, mask=~mana_known),
    }


EVENT = T.StructType([T.StructField("file_id", T.StringType())] + [T.StructField(n, t) for names, t in (
    (("row", "wall_ms"), T.LongType()), (("code",), T.StringType()), (("support",), T.BooleanType()), (("src", "src_name"), T.StringType()), (("src_flags",), T.LongType()), (("dst", "dst_name"), T.StringType()), (("dst_flags", "spell_id"), T.LongType()),
    (("spell",), T.StringType()), (("extra_spell_id",), T.LongType()), (("extra_spell",), T.StringType()), (("amount",), T.DoubleType()), (("waste", "absorbed"), T.LongType()), (("crit", "buff", "shield_off"), T.BooleanType()), (("miss",), T.StringType()), (("avoided",), T.BooleanType()),
    (("caster", "caster_name", "environment"), T.StringType()), (("environment_kind",), T.IntegerType()), (("feigned",), T.BooleanType()), (("supporter", "subject", "owner"), T.StringType()), (("hp", "hp_max"), T.LongType()), (("x", "y"), T.DoubleType()), (("map", "mana"), T.LongType()),
) for n in names])


def decoded(lines: DataFrame, places: DataFrame, assumed_year: int = 2024) -> DataFrame:
    """The typed event table of lines whose parts are told by ``places``."""
    joined = placed(lines, places).select("file_id", "part", "row", "line", "width_row", "width", "slot_row", "slot", "falls")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch):
                yield _decoded_run(run, assumed_year)

    return _batches(joined, read, EVENT)


def _decoded_run(run: pa.RecordBatch, assumed_year: int) -> pa.RecordBatch:
    width_row, width, slot_row, slot, falls = (run.column(k)[0].as_py() for k in range(4, 9))
    lines = Lines.of(run.column(3))
    row = np.asarray(run.column(2))[lines.at]
    wall, real = wall_ms(lines, np.searchsorted(np.array(falls or [], dtype=np.int64), row, "right"), assumed_year)
    since = lambda at, value, default: np.full(len(row), default) if at is None else np.where(row >= at, value, default)
    e = _Events(lines, row, wall, since(width_row, width, log.DEFAULT_WIDTH), since(slot_row, slot, 2))
    found = _columns(e)
    found = {"file_id": pa.array([run.column(0)[0].as_py()] * len(e.n), pa.string()), **found}
    out = pa.RecordBatch.from_arrays([found[f.name] for f in EVENT], names=EVENT.names)
    return out.filter(pa.array(real[e.keep]))
