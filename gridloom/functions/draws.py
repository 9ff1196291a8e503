"""Draws that any engine repeats: numbers from the MD5 of a text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 7


def drawn(text: Column, n: int | Column) -> Column:
    """A number 0 .. n - 1 from the first hexadecimal digits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def drawn_sql(text: str, n: str) -> str:
    """The same in SQL."""
    digits = " + ".join(f"(strpos('0123456789abcdef', substr(md5({text}), {k + 1}, 1)) - 1) * {16 ** (DIGITS - 1 - k)}" for k in range(DIGITS))
    return f"(({digits}) % ({n}))"
