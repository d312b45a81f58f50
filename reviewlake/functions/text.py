"""Column helpers over file names and file texts. All of them stay on the JVM side."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from reviewlake import catalog
from reviewlake.functions.regex import SPACE_CLASS, STRIP

_ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
# White space at the start of a line, never running into the next line.
_LINE_INDENT = rf"(?Udm)^[{SPACE_CLASS}&&[^\n]]*+"


def file_ext(filename: Column) -> Column:
    """Lower-case suffix of the last path part, ``''`` if there is none."""
    name = F.regexp_extract(filename, r"([^/]+)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def is_skipped_path(filename: Column) -> Column:
    """Any of the skipped path parts anywhere in the name (a plain, case-sensitive substring test)."""
    return filename.rlike("|".join(re.escape(part) for part in catalog.SKIPPED_PATHS))


def is_code_file(filename: Column) -> Column:
    """A known code suffix and no skipped path part."""
    return file_ext(filename).isin(*catalog.CODE_EXTENSIONS) & ~is_skipped_path(filename)


def has_content(content: Column) -> Column:
    return content.isNotNull() & (content != "")


def strip(text: Column) -> Column:
    """Strip Unicode white space and the separators ``\\x1c``-``\\x1f``; ASCII takes a faster way to the same result."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.btrim(text, F.lit(_ASCII_SPACE))).otherwise(F.regexp_replace(text, STRIP, ""))


def strip_sql(column: str) -> str:
    """``strip`` as SQL text."""
    ascii_space = "".join(f"\\u{ord(char):04x}" for char in _ASCII_SPACE)
    return (
        f"if(octet_length({column}) = length({column}), btrim({column}, '{ascii_space}'), "
        f"regexp_replace({column}, r'{STRIP}', ''))"
    )


def split_lines(content: Column) -> Column:
    """Lines by ``\\n`` alone; a trailing newline gives a last, empty line."""
    return F.split(content, "\n")


def decode_utf8(data: Column) -> Column:
    """Bytes to text; NULL if they are not UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def unify_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` to ``\\n``, as reading in text mode does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def percent(ratio: Column) -> Column:
    """One-decimal percentage with ties to even (0.3125 is 31.2%), for ratios of 0.16 or more.

    The value is rounded as the binary number it is: scaled by a power of two it becomes an integer,
    and the rest is integer arithmetic. ``bround`` rounds the decimal digits it prints instead.
    """
    one = 1 << 48
    scaled = (ratio * 100 * F.lit(float(one))).cast("long") * 10
    whole = scaled.bitwiseAND(F.lit(-one))
    rest = scaled - whole
    tenths = F.shiftright(scaled, 48)
    up = (rest > one >> 1) | ((rest == one >> 1) & (F.pmod(tenths, F.lit(2)) == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"),
        F.lit("%"),
    )


def non_blank_lines(content: Column) -> Column:
    """Number of lines with anything but white space on them."""
    return F.regexp_count(content, F.lit(_LINE_INDENT + r"[^\s\x1c-\x1f]"))


def comment_lines(content: Column, ext: Column) -> Column:
    """Number of lines whose first text is the comment marker of the file's suffix."""
    return F.when(
        ext.isin(*catalog.HASH_COMMENT_EXTENSIONS), F.regexp_count(content, F.lit(_LINE_INDENT + "#"))
    ).otherwise(F.regexp_count(content, F.lit(_LINE_INDENT + "//")))
