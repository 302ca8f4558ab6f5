"""Text helpers on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_number(s: Column) -> Column:
    return s.rlike(r"^[0-9]+$")


def is_date(s: Column) -> Column:
    return s.rlike(r"^[0-9]{8,}$")


def same_ci(a: Column, b: Column, n: int | None = None) -> Column:
    """Equal without regard to case, in the first n characters if n is given."""
    return F.lower(a if n is None else F.left(a, F.lit(n))) == F.lower(b if n is None else F.left(b, F.lit(n)))


def prefix_ci(s: Column, prefix: str) -> Column:
    return F.lower(s).startswith(prefix.lower())


def divide(s: Column, mark: str) -> Column:
    """Array of the parts before and after the first mark; the second is null without one."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.array(F.substr(s, F.lit(1), at - 1), F.substr(s, at + len(mark)))).otherwise(F.array(s, F.lit(None)))


def index_of(s: Column, part: str) -> Column:
    """Place from 0, or -1."""
    return F.instr(s, part) - 1


def token(s: Column, mark: str, n: int) -> Column:
    """The n-th token from 0, or null."""
    return F.get(F.split(s, re.escape(mark)), F.lit(n))


def token_count(s: Column, mark: str) -> Column:
    return F.size(F.split(s, re.escape(mark)))


def has_any(s: Column, chars: str) -> Column:
    return s.rlike("[" + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]")


def call_parts(s: Column) -> Column:
    """``name(args)`` -> struct of name and args."""
    pattern = r"^\s*([^()\s]+)\s*\((.*)\)\s*$"
    return F.struct(F.regexp_extract(s, pattern, 1).alias("name"), F.regexp_extract(s, pattern, 2).alias("args"))


def leading_int(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"^\s*([-+]?[0-9]+)", 1), F.lit("")).cast("long")


def replace_first(s: Column, old: str, new: str) -> Column:
    """The first occurrence replaced; an empty text where there is none."""
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substr(s, F.lit(1), at - 1), F.lit(new), F.substr(s, at + len(old)))).otherwise(F.lit(""))


def affix_swap(s: Column, pairs: dict[str, str]) -> Column:
    """Market prefixes to suffixes and back: SH600600 <-> 600600.SSE; others unchanged."""
    out = s
    for prefix, suffix in pairs.items():
        end = "." + suffix
        out = F.when(s.startswith(prefix), F.concat(F.substr(s, F.lit(len(prefix) + 1)), F.lit(end))).when(s.endswith(end), F.concat(F.lit(prefix), F.substr(s, F.lit(1), F.length(s) - len(end)))).otherwise(out)
    return out


def hash_bucket(s: Column, n: int) -> Column:
    """Sum of (byte mod n), mod n, over the UTF-8 bytes."""
    code = lambda i: F.conv(F.substr(F.hex(s.cast("binary")), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    places = F.sequence(F.lit(0), F.octet_length(s) - 1)
    total = F.aggregate(F.when(F.octet_length(s) > 0, F.transform(places, lambda i: code(i) % n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)
    return total % n


def merge(parts: Column, mark: str) -> Column:
    return F.array_join(parts, mark)


def line_around(s: Column, at: Column) -> Column:
    """The line that holds place ``at`` (from 0) and the one before it, with the line end before both."""
    before = F.split(F.substr(s, F.lit(1), at + 1), "\n")
    head = F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.least(F.size(before), F.lit(2))), "\n")
    head = F.when(F.size(before) > 2, F.concat(F.lit("\n"), head)).otherwise(head)
    ends = F.substr(s, at + 1, F.lit(1)) == "\n"
    return F.when(ends, F.rtrim(head, F.lit("\n"))).otherwise(F.concat(head, F.get(F.split(F.substr(s, at + 2), "\n"), F.lit(0))))


def around(s: Column, sign: str) -> Column:
    """Struct of what stands before a sign and after it (null without one), as of 'scheme://rest'."""
    parts = divide(s, sign)
    return F.struct(parts[0].alias("before"), parts[1].alias("after"))


def token_match(s: Column, part: str, mark: str) -> Column:
    """0 where the first place of ``part`` ends at a mark or the text's end, 1 where it goes on, -1 without it."""
    at = F.instr(s, part)
    after = F.substr(s, at + len(part), F.lit(1))
    return F.when(at == 0, -1).when((after == "") | (after == mark), 0).otherwise(1)


#: The symbols of identifiers.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
LETTERS = CAPITALS + "abcdefghijklmnopqrstuvwxyz"


def random_id(key: Column, n: int, seed: int = 0, symbols: str = LETTERS) -> Column:
    """n symbols drawn by a row's key and a seed: the same again whenever a task is run again."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substr(F.lit(symbols), (F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(len(symbols))) + 1).cast("int"), F.lit(1)))
    return F.array_join(drawn, "")


def time_id(time: Column, key: Column, n: int = 16, seed: int = 0) -> Column:
    """yyMMddHHmmss, then symbols up to n characters."""
    return F.concat(F.date_format(time, "yyMMddHHmmss"), random_id(key, n - 12, seed, CAPITALS)) if n > 12 else F.date_format(time, "yyMMddHHmmss")
