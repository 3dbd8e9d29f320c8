"""Names, numbers and text formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: One field of a comma-separated line with quotes and nested brackets: quotes, two levels of [], three of ().
FIELD = r'((?:"[^"]*(?:"|$)|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|[^,"\[(])*)(?:,|$)'


def split_fields(line: Column) -> Column:
    """Fields of a line; commas in quotes or brackets do not split. The pattern's last, empty match is cut off.

    Most lines have no brackets and no comma between quotes; they are split at the commas, which is several
    times faster than the pattern and gives the same fields.
    """
    found = F.regexp_extract_all(line, F.lit(FIELD), F.lit(1))
    nested = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    quoted = F.exists(F.transform(F.split(line, '"'), lambda x, i: (i % 2 == 1) & x.contains(",")), lambda x: x)
    plain = (line != "") & (F.instr(line, "[") == 0) & (F.instr(line, "(") == 0) & ~line.endswith(",") & ~quoted
    return F.when(plain, F.split(line, ",")).otherwise(nested)


def ability_name(name: Column) -> Column:
    """A name without a trailing parenthesis or " Off-Hand", taken off at most twice."""
    for _ in range(2):
        name = F.regexp_replace(name, r"^(.+?)(?: \([^()]*\)| Off-Hand)$", "$1")
    return name


def field_int(raw: Column) -> Column:
    """Leading integer of a field; ``nil`` and other text are null."""
    found = F.regexp_extract(raw, r"^([+-]?\d+)", 1)
    return F.when(found != "", found.cast("long"))


def field_float(raw: Column) -> Column:
    found = F.regexp_extract(raw, r"^([+-]?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def field_hex(raw: Column) -> Column:
    """``0x`` or plain hexadecimal digits as a long."""
    found = F.regexp_extract(raw, r"^(?:0[xX])?([0-9a-fA-F]+)", 1)
    return F.when(found != "", F.conv(found, 16, 10).cast("long"))


def field_bool(raw: Column) -> Column:
    """``1``, ``true`` or any other first character than 0 and not ``nil``; empty is false."""
    return (raw != "") & (raw != "nil") & (F.substring(raw, 1, 1) != "0") & (raw != "false")


def field_text(raw: Column, fallback: str = "") -> Column:
    """A field without its quotes; ``nil`` gives the fallback."""
    return F.when(raw == "nil", F.lit(fallback)).otherwise(F.regexp_replace(raw, r'^"([^"]*)"?$', "$1"))


def short_number(x: Column) -> Column:
    """1234567 as 1.2m, 12345 as 12k, 123 as 123."""
    a = F.abs(x)
    return (
        F.when(a >= 1e9, F.concat(F.format_number(x / 1e9, 1), F.lit("b"))).when(a >= 1e6, F.concat(F.format_number(x / 1e6, 1), F.lit("m")))
        .when(a >= 1e4, F.concat(F.format_number(x / 1e3, 0), F.lit("k"))).otherwise(F.format_number(x, 0))
    )


def clock(ms: Column) -> Column:
    """Milliseconds as m:ss, negative ones with a sign."""
    s = F.floor(F.abs(ms) / 1000).cast("long")
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * share, digits), F.lit("%"))


def slug(name: Column) -> Column:
    """Lower-case letters and digits, runs of others as one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, "['’]", "")), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def short_name(name: Column) -> Column:
    """What stands before the first dash (a name without its home)."""
    return F.substring_index(name, "-", 1)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): also for negative halves."""
    return F.floor(x + 0.5)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long: a fold over the hexadecimal digits."""
    hexed = F.hex(text.cast("binary"))
    step = lambda h, b: ((h.bitwiseXOR(F.conv(b, 16, 10).cast("long"))) * F.lit(16_777_619)) % F.lit(1 << 32)
    return F.aggregate(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), F.lit(2_166_136_261).cast("long"), step)


def delta_ids(packed: Column) -> Column:
    """Dot-separated base-36 deltas as the ascending ids they sum to."""
    steps = F.transform(F.split(packed, r"\."), lambda x: F.conv(x, 36, 10).cast("long"))
    grow = lambda out, d: F.concat(out, F.array(F.coalesce(F.element_at(out, -1), F.lit(0)) + d))
    return F.when(packed == "", F.array().cast("array<bigint>")).otherwise(F.aggregate(steps, F.array().cast("array<bigint>"), lambda out, d: F.when(F.size(out) == 0, F.array(d)).otherwise(grow(out, d))))


def mask_names(mask: Column, names: list[str]) -> Column:
    """Names of the bits set in a mask, lowest first."""
    return F.filter(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names))), lambda x: x.isNotNull())
