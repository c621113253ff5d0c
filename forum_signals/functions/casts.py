"""Tolerant integer parsing for attribute values that arrive as text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT_SEPARATOR = r"(?<=[0-9])_(?=[0-9])"


#: Every decimal digit beyond ASCII, and the ASCII digits of the same value.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)
#: Blanks beyond ASCII at either end.
OTHER_BLANKS = "".join(c for c in map(chr, range(0x80, 0x10000)) if c.isspace())
ENDS = rf"^[\s{OTHER_BLANKS}]+|[\s{OTHER_BLANKS}]+$"


def safe_int(value: Column, data_type: str, default: int | None = None) -> Column:
    """``value`` as an integer type; missing, malformed or out-of-range text gives ``default``.

    Surrounding blanks, a sign and ``_`` between digits are accepted; blanks and digits may be of any script.
    """
    plain = F.regexp_replace(F.translate(value, OTHER_DIGITS, ASCII_DIGITS), ENDS, "")
    ascii_only = F.when(value.rlike(r"[^\x00-\x7f]"), plain).otherwise(value)
    # what Spark reads as it stands is spared the expressions
    parsed = F.coalesce(value.try_cast(data_type), F.regexp_replace(ascii_only, DIGIT_SEPARATOR, "").try_cast(data_type))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast(data_type))
