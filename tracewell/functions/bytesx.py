"""Bytes, packed times, addresses and small formats as Column expressions; all within whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def latin1(b: Column | str) -> Column:
    """Bytes as a string of as many characters, for patterns over bytes."""
    return F.decode(col(b), "ISO-8859-1")


def le(b: Column | str, at: int | Column, size: int) -> Column:
    """The little-endian unsigned number of `size` bytes from 0-based `at`; null past the end. Eight bytes give a decimal."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.substring(col(b), at + 1, F.lit(size))
    number = F.conv(_reversed_hex(part, size), 16, 10)
    return F.when(F.octet_length(part) == size, number.cast("decimal(20,0)" if size == 8 else "bigint"))


def _reversed_hex(part: Column, size: int) -> Column:
    h = F.hex(part)
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))))


def packed_time(v: Column | str) -> Column:
    """Bits from the top: year after 2000 (6), month (4), day (5), hour (5), minute (6), second (6). Impossible dates are null."""
    v = col(v).cast("bigint")
    part = lambda shift, bits: F.shiftright(v, shift).bitwiseAND((1 << bits) - 1)
    made = F.try_make_timestamp_ntz(2000 + part(26, 6), part(22, 4), part(17, 5), part(12, 5), part(6, 6), part(0, 6))
    return F.when(part(0, 6) < 60, made)


def pack_time(ts: Column | str) -> Column:
    """The inverse of packed_time for 2000 to 2063; parts of seconds are dropped, other years are an error."""
    ts = col(ts)
    years = F.year(ts) - 2000
    bits = [(years, 26), (F.month(ts), 22), (F.day(ts), 17), (F.hour(ts), 12), (F.minute(ts), 6), (F.second(ts), 0)]
    total = sum((x.cast("bigint") * (1 << s) for x, s in bits[1:]), bits[0][0].cast("bigint") * (1 << 26))
    return F.when(years.between(0, 63), total).when(ts.isNotNull(), F.raise_error("year out of range").cast("bigint"))


def overlapping(s: Column | str, pattern: str) -> Column:
    """Occurrences of a literal, those that overlap too."""
    return F.regexp_count(col(s), F.lit(f"(?=\\Q{pattern}\\E)"))


def disjoint(s: Column | str, pattern: str) -> Column:
    """Occurrences of a literal from left to right without overlaps."""
    return F.regexp_count(col(s), F.lit(f"\\Q{pattern}\\E"))


def padding(b: Column | str) -> Column:
    """Only 00 and FF bytes; nothing is padding too."""
    return latin1(b).rlike("^[\\x00\\xFF]*$")


def video_pes(b: Column | str) -> Column:
    """Start codes 000001 whose fourth byte is E0 to EF; each start code takes four bytes, whatever follows."""
    ids = F.regexp_extract_all(latin1(b), F.lit("(?s)\\x00\\x00\\x01(.)"), F.lit(1))
    return F.size(F.filter(ids, lambda c: c.between("à", "ï")))


def guid(b: Column | str) -> Column:
    """Text of a GUID of 16 bytes: three little-endian groups, then two as they are."""
    h = F.lower(F.hex(col(b)))
    order = [[3, 2, 1, 0], [5, 4], [7, 6], [8, 9], [10, 11, 12, 13, 14, 15]]
    groups = [F.concat(*(F.substring(h, 2 * i + 1, 2) for i in g)) for g in order]
    return F.when(F.octet_length(col(b)) == 16, F.concat_ws("-", *groups)).otherwise(h)


def stripe(offset: Column | str, members: int, stripe_size: int, start: int = 0) -> tuple[Column, Column]:
    """Member and its offset for an offset of a RAID-0 set."""
    if members < 2 or stripe_size < 512 or stripe_size & (stripe_size - 1):
        raise ValueError("at least two members, and stripes of a power of two from 512 on")
    offset = col(offset)
    number = F.floor(offset / stripe_size)
    return F.pmod(number, F.lit(members)), F.floor(number / members) * stripe_size + F.pmod(offset, F.lit(stripe_size)) + start


#: Multiples by suffix: fixed values.
UNITS = {"": 1, "b": 1, "k": 1000, "kb": 1000, "m": 1000**2, "mb": 1000**2, "g": 1000**3, "gb": 1000**3, "t": 1000**4, "tb": 1000**4, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def byte_size(s: Column | str) -> Column:
    """Bytes of '4096', '0x1000', '1.5 KiB', '2GB'; null for what is no size or no whole number of bytes."""
    s = F.lower(F.trim(col(s)))
    digits = F.regexp_extract(s, r"^0x([0-9a-f]{1,15})$", 1)
    number = F.regexp_extract(s, r"^([0-9]{1,18}(?:\.[0-9]{1,9})?)\s*([a-z]*)$", 1)
    unit = F.regexp_extract(s, r"^([0-9]{1,18}(?:\.[0-9]{1,9})?)\s*([a-z]*)$", 2)
    times = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), unit)
    exact = F.try_multiply(number.try_cast("decimal(27,9)"), times.cast("decimal(13,0)"))
    whole = F.when((number != "") & times.isNotNull() & (exact == F.floor(exact)), exact.cast("bigint"))
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint")).otherwise(whole)


def glob_regex(pattern: str) -> str:
    """The regular expression, over lower-case text, of a glob with *, ? and [sets]."""
    out, i, p = "", 0, pattern.casefold()
    while i < len(p):
        c = p[i]
        end = p.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = p[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return f"(?s)^{out}$"


def fraction(s: Column | str) -> Column:
    """'30000/1001' or '25' as a double; null for 0/0, N/A and what is no number."""
    parts = F.split(col(s), "/")
    top, below = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double")
    return F.when((F.size(parts) <= 2) & (below != 0), top / below)


def label(ts: Column | str) -> Column:
    """HH-MM."""
    return F.date_format(col(ts), "HH-mm")


def case_id(s: Column | str) -> Column:
    return col(s).rlike("^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$")


def path_safe(s: Column | str) -> Column:
    """No separator and no NUL."""
    return ~col(s).rlike("[/\\\\\\x00]")


def entropy(counts: Column | str) -> Column:
    """Bits per symbol from an array of counts; 0 for none."""
    counts = F.filter(col(counts), lambda c: c > 0)
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    return F.when(total > 0, F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / total * F.log2(c / total))).otherwise(0.0)


def fat_label(s: Column | str) -> Column:
    return F.regexp_replace(col(s), "[ \\x00]+$", "")
