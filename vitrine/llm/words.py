"""Words, whitespace and ids as the operators of this subpackage read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The six characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLANK_CLASS = r"[\x20\x09-\x0D]"
LAST_ID = 2**63 - 1


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_key(column: str) -> Column:
    """The id used for order and joins: a null id comes after every other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def squeeze(text: Column) -> Column:
    """The text without its blanks; plain replacements are much cheaper than a regular expression."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def split_blanks(text: Column) -> Column:
    """The pieces between blanks, some of them empty. Most texts know the space alone, and splitting at it needs no regular expression."""
    other = F.contains(text, F.lit(BLANKS[1]))
    for c in BLANKS[2:]:
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.split(text, BLANK_CLASS)).otherwise(F.split(text, " "))


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than blanks, in order."""
    return F.array_remove(split_blanks(text), "")
