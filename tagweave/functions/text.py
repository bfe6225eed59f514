"""String helpers that reproduce Python ``str`` behaviour with built-ins."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


# what Python's str.strip() removes: Unicode white space and the four
# separators U+001C to U+001F
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind
    (Spark ``trim`` only removes spaces)."""
    # the regex only runs when an end character is whitespace (rare); its
    # "\s+$" branch would otherwise be tried at every position of every text
    edge = F.substring(c, 1, 1).rlike(_SPACE) | F.substring(c, -1, 1).rlike(_SPACE)
    return F.when(edge, F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")).otherwise(c)


_ASCII_SPACE = b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_SPACES = _ASCII_SPACE.decode() + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_lines(lines: pa.Array) -> pa.Array:
    """``py_strip`` of Arrow strings; lines that are no valid UTF-8 lose ASCII
    white space only."""
    try:
        return pc.utf8_trim(lines, _SPACES)
    except pa.ArrowInvalid:
        def one(x: bytes) -> bytes:
            try:
                return x.decode().strip(_SPACES).encode()
            except UnicodeDecodeError:
                return x.strip(_ASCII_SPACE)
        return pa.array([one(x) for x in lines.cast(pa.binary()).to_pylist()], pa.binary()).view(pa.string())


def leading_space(c: Column) -> Column:
    """How many characters ``py_strip`` removes at the start."""
    return F.when(F.substring(c, 1, 1).rlike(_SPACE), F.length(F.regexp_extract(c, rf"^{_SPACE}+", 0))).otherwise(F.lit(0))


def normalize_ws(c: Column) -> Column:
    """Collapse every whitespace run to one space, then strip."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def split_words(c: Column) -> Column:
    """Split on a single space, keeping empty words (``str.split(' ')``)."""
    return F.split(c, " ", -1)
