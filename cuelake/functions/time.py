"""Subtitle times as columns: text to integer milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
#: A time line from its start on; what follows the second time is ignored.
TIME_LINE = rf"^{_CLOCK}\s*-->\s*{_CLOCK}"
#: A whole time line, hours of any length, comma or dot.
STRICT_LINE = r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{3})\s*$"


def _clock_ms(line: Column, pattern: str, first: int) -> Column:
    part = lambda k: F.regexp_extract(line, pattern, first + k).try_cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def start_ms(line: Column, pattern: str = TIME_LINE) -> Column:
    """Start of a time line; null if it does not match."""
    return _clock_ms(line, pattern, 1)


def end_ms(line: Column, pattern: str = TIME_LINE) -> Column:
    return _clock_ms(line, pattern, 5)


def bounds_or_zero(line: Column) -> Column:
    """struct(start_ms, end_ms); both 0 where the line does not match."""
    return F.struct(F.coalesce(start_ms(line), F.lit(0).cast("long")).alias("start_ms"), F.coalesce(end_ms(line), F.lit(0).cast("long")).alias("end_ms"))


def bounds_or_fail(line: Column) -> Column:
    """struct(start_ms, end_ms); an error where the line does not match or ends before it starts."""
    a, b = start_ms(line, STRICT_LINE), end_ms(line, STRICT_LINE)
    bad = F.raise_error(F.concat(F.lit("not a time line: "), F.coalesce(line, F.lit("null"))))
    return F.when(a.isNotNull() & (b >= a), F.struct(a.alias("start_ms"), b.alias("end_ms"))).otherwise(bad.cast("struct<start_ms:bigint,end_ms:bigint>"))


def duration_or_zero(line: Column) -> Column:
    """Duration of a time line, at least 0; 0 where it does not match."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(end_ms(line) - start_ms(line), F.lit(0).cast("long")))


def loose_clock_ms(text: Column) -> Column:
    """One clock time: a dot is a comma, missing milliseconds are 000."""
    norm = F.replace(F.trim(text), F.lit("."), F.lit(","))
    full = F.when(F.instr(norm, ",") > 0, norm).otherwise(F.concat(norm, F.lit(",000")))
    p = r"^(\d+):(\d+):(\d+),(\d+)$"
    part = lambda k: F.regexp_extract(full, p, k).try_cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def campaign_seconds(text: Column) -> Column:
    """``S``, ``MM:SS`` or ``HH:MM:SS`` to seconds; null for anything else."""
    parts = F.split(F.trim(text), ":")
    at = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 1, at(0)).when(F.size(parts) == 2, at(0) * 60 + at(1)).when(F.size(parts) == 3, (at(0) * 60 + at(1)) * 60 + at(2))


def format_ms(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm; below 0 is 0."""
    t = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    h, m, s = F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, t % 1000)


def format_seconds(seconds: Column) -> Column:
    """Seconds as HH:MM:SS,mmm, rounded half to even."""
    return format_ms(F.bround(seconds * 1000, 0))


def time_line(start: Column, end: Column) -> Column:
    return F.concat(format_ms(start), F.lit(" --> "), format_ms(end))


def interior_fractions(count: Column) -> Column:
    """``count`` evenly spaced fractions inside (0, 1)."""
    return F.when(count < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), count), lambda i: F.round(i / (count + 1), 6)))


def parse_fractions(text: Column) -> Column:
    """Comma-separated fractions; null unless strictly increasing inside (0, 1)."""
    found = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    inside = F.forall(found, lambda x: x.isNotNull() & (x > 0) & (x < 1))
    rising = F.forall(F.sequence(F.lit(1), F.size(found)), lambda i: (i == 1) | (F.get(found, i - 1) > F.get(found, i - 2)))
    return F.when(inside & rising, found)
