"""Key normalization as native column expressions.

Two normal forms live here:

``norm_zone_key``  the form in which the regionalization API joins zones, flows and
                   adjacency: numbers are truncated to integers, other text is stripped.
``zone_key``       the form in which written zone references of the data tables are compared:
                   letters and digits only, upper case; blank references become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a float literal looks like, and the shape of a full zone key.
FLOAT_LITERAL = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
FULL_ZONE_KEY = r"^[A-Z]{2}[0-9]{7}[A-Z]?$"

_BIGINT_SAFE = 9.2e18
_DECIMAL_SAFE = 1e38


def _int_text(number: Column) -> Column:
    """Text of a double truncated toward zero; null where it is too large for 38 digits."""
    return F.when(F.abs(number) < _BIGINT_SAFE, number.cast("bigint").cast("string")).when(
        F.abs(number) < _DECIMAL_SAFE, number.cast("decimal(38,0)").cast("string")
    )


def norm_zone_key(column: Column, data_type: T.DataType | None = None) -> Column:
    """Normal form of a zone id.

    Null, NaN, empty and blank ids give null. Whatever reads as a finite number is truncated
    toward zero and printed as an integer (``"007"`` and ``7.9`` both give ``"7"``). Everything
    else, ``"nan"`` and ``"inf"`` included, is stripped text. Finite numbers of 1e38 and more stay
    as text. ``data_type`` is the column's type; without it the column is read as text.
    """
    if isinstance(data_type, T.IntegralType):
        return column.cast("string")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        number = column.cast("double")
        return F.when(F.isnan(number), None).otherwise(F.coalesce(_int_text(number), column.cast("string")))
    text = F.regexp_replace(column.cast("string"), r"(?U)^\s+|\s+$", "")
    number = F.when(text.rlike(FLOAT_LITERAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(text == "", None).otherwise(F.coalesce(_int_text(number), text))


def zone_key(column: Column) -> Column:
    """Letters and digits of a written reference in upper case; null for a blank reference.

    Whether it is null is decided by a search for the first letter or digit, and to the optimizer the rest
    can't be null: so the filters that joins and tests on a key infer don't normalize the text once more."""
    text = column.cast("string")
    return F.when(text.rlike(r"[\p{L}\p{Nd}]"), F.coalesce(F.upper(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", "")), F.lit("")))


def letters_and_digits(column: Column) -> Column:
    """Letters and digits of a text in upper case. Null stays null, a text without any gives ''."""
    return F.upper(F.regexp_replace(column.cast("string"), r"[^\p{L}\p{Nd}]+", ""))


def is_full_zone_key(key: Column) -> Column:
    """Whether a zone key is two letters, two digits, five digits and at most one letter more."""
    return F.coalesce(key.rlike(FULL_ZONE_KEY), F.lit(False))


def is_number(column: Column) -> Column:
    """Neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)
