"""Text expressions and folders that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blank characters, fixed values: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A null id counts as the smallest one.
NULL_ID = -(2**63)


def whole(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without blanks at both ends, in linear time."""
    return F.btrim(text, F.lit(BLANKS))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII only take the faster way to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def words(text: Column) -> Column:
    body = strip(whole(text))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_RUN))


def n_words(text: Column) -> Column:
    """Number of words of a stripped, non-empty text; single spaces only take the faster way to the same result."""
    odd = F.contains(text, F.lit("  "))
    for blank in BLANKS[1:]:
        odd = odd | F.contains(text, F.lit(blank))
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(text, BLANK_RUN))).otherwise(spaces + 1)


def lines(text: Column) -> Column:
    """Split at line feeds; an empty text is one empty line."""
    return F.split(whole(text), "\n")


def row_key(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (null as the smallest id), ``text_key`` and ``text``, and further columns as they are.

    Rows that share id and text are the same document to the operators that join back by this pair.
    """
    text = whole(F.col("text"))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.xxhash64(text).alias("text_key"), text.alias("text"), *more,
    )


#: Bits of a set of keys that come again.
SET_BITS = 1 << 20


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SET_BITS)).cast("int")


def repeated_keys(keys: DataFrame) -> Column:
    """The set of the values of the one column that come again, as bits in 64-bit words: one value for a whole plan."""
    name = keys.columns[0]
    again = keys.groupBy(name).count().where("count > 1").select(_bit(F.col(name)).alias("bit"))
    words = again.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)))).alias("bits")
    )
    every = keys.sparkSession.range(SET_BITS // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    in_order = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(in_order["bits"].alias("bits")).scalar()


def may_be_in(key: Column, bits: Column) -> Column:
    """True for all keys of the set, and for the few that only share the bit of one."""
    return F.getbit(F.get(bits, F.shiftright(_bit(key), 6)), _bit(key).bitwiseAND(F.lit(63))) == 1


def real_id(doc_id: Column) -> Column:
    """Back from the stand-in of a null id."""
    return F.when(doc_id != NULL_ID, doc_id)


def kept_positions(n: Column, gone: Column) -> Column:
    """Positions 0 to n-1 but for those in ``gone``, which may be null."""
    every = F.sequence(F.lit(0), n - 1)
    return F.when(gone.isNull(), every).otherwise(F.array_except(every, gone))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the given positions."""
    own = lines(text)
    return F.array_join(F.transform(kept_positions(F.size(own), gone), lambda i: F.get(own, i)), "\n")
