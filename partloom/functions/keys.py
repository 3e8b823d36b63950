"""Normal forms of keys, codes and source names, as columns."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: every character that Unicode counts as white space, the byte order mark and the zero-width space
WHITE = "".join(c for c in map(chr, range(sys.maxunicode)) if c.isspace()) + "﻿​"


def stripped(c: Column | str) -> Column:
    """c without surrounding white space; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.btrim(c.cast("string"), F.lit(WHITE))
    return F.nullif(s, F.lit(""))


def key(c: Column | str) -> Column:
    """Normal form of keys, codes, statuses and bands: stripped and in upper case; null if blank."""
    return F.upper(stripped(c))


def source_key(c: Column | str) -> Column:
    """Normal form of source names, regardless of blank, - or _ as separator; null if blank."""
    return F.nullif(F.translate(key(c), " \t-_", ""), F.lit(""))
