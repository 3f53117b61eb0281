"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, the non-breaking ones included.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]+"


def squeeze(c: Column) -> Column:
    """Trimmed, with inner runs of white space as one blank."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Key under which names compare: trimmed, white space collapsed, lower case; blank gives null."""
    x = F.lower(squeeze(c))
    return F.when(x != "", x)
