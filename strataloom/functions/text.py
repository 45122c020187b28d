"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that count as white space when text is trimmed (ASCII ones, separators, and information separators).
WHITE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space, not just blanks."""
    return F.trim(c, F.lit(WHITE))


def rtrim_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def split_lines(c: Column) -> Column:
    """Lines by CRLF, LF or a lone CR; a final line break gives a final empty line."""
    return F.split(c, "\r\n|\n|\r", -1)


def before(c: Column, mark: str) -> Column:
    """The text before the first ``mark``, all of it if there is none."""
    return F.substring_index(c, mark, 1)


def after(c: Column, mark: str) -> Column:
    """The text behind the first ``mark``, all of it if there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c))).otherwise(c)


def json_text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})
