"""Parsing, rounding and formatting of single values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def price(text: Column) -> Column:
    """Price text as a double, NULL when it is no number."""
    return text.try_cast("double")


def digit_count(text: Column) -> Column:
    """`1,284` as 1284; NULL when nothing but separators is left."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def number(column: Column, data_type: str) -> Column:
    """A feature as a double when it is a number; booleans and text count as missing."""
    if data_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or data_type.startswith("decimal"):
        return column.cast("double")
    return F.lit(None).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when the whole is zero or missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def growth(last: Column, prior: Column) -> Column:
    """(last - prior) / max(prior, 1); NULL when either side is missing."""
    return F.when(prior.isNotNull(), (last - prior) / F.greatest(prior, F.lit(1)).cast("double"))


def three_decimals(value: Column) -> Column:
    """`0.494` style text, `n/a` for a missing value."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", value.cast("double")))


def seeded_order(seed: int | str, *keys: Column) -> Column:
    """Hex text that orders rows like a seeded shuffle: same seed and key, same place, on any cluster."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def matching_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, ignoring case, in the order given."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(t.lower()), F.lit(t)) for t in terms]))


def required_literal(pattern: str) -> str | None:
    """The longest run of plain characters every match of a pattern must contain, lower-cased; None when unsure.

    Groups, classes and optional characters are stepped over; an alternation at the top or an escape that
    is not one of the plain classes gives no answer.
    """
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i += 1 + (pattern[i + 1] == "^")
            i += pattern[i] == "]"
            while pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
        if c == "\\" and pattern[i + 1].isalnum() and pattern[i + 1] not in "dswDSWbB":
            return None
        plain = c == "\\" and not pattern[i + 1].isalnum()
        i += c == "\\"
        if c == "|" and depth == 0:
            return None
        depth += (c == "(") - (c == ")")
        if c in "*?{":
            run = run[:-1]
            i = pattern.index("}", i) if c == "{" else i
        if depth == 0 and (plain or (c.isascii() and c not in "[()*?{+.^$|\\")):
            run += pattern[i]
        else:
            runs, run = [*runs, run], ""
        i += 1
    return max([*runs, run], key=len).lower() or None


def may_match(lowered: Column, pattern: str) -> Column:
    """Cheap necessary condition for an ignore-case match, tested on text lower-cased once."""
    literal = required_literal(pattern)
    return lowered.contains(literal) if literal else F.lit(True)


def exploded(df: DataFrame, keep: list, array: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array, with its 0-based position when asked for.

    For a plain explode the optimizer adds a size filter that computes the array again; the outer form with
    a null filter behind it computes it once. Elements are never NULL in the arrays this is used for.
    """
    made = F.posexplode_outer(array).alias(position, name) if position else F.explode_outer(array).alias(name)
    return df.select(*keep, made).where(F.col(name).isNotNull())


def cut(text: Column, cap: int | None) -> Column:
    """The text, or its first `cap` characters."""
    return text if cap is None else F.substr(text, F.lit(1), F.lit(cap))
