"""Trimming, first-non-blank picks, lenient numbers and e-mail rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts as blank in feed text (the Unicode
# space separators, line ends and the byte-order mark), not only U+0020.
BLANKS = (
    "\t\n\x0b\x0c\r\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Number spelling accepted from feed text.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|Infinity)$"
EMAIL_MAX = 254


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def non_blank(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trim_blanks(text), F.lit(""))


def is_container(text: Column) -> Column:
    """True for text that is itself a JSON object or array."""
    return F.coalesce(
        text.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(),
        F.lit(False),
    )


def scalar_text(text: Column) -> Column:
    """Feed value as text; nested objects and arrays have no text form."""
    return F.when(~is_container(text), text)


def first_of(values: str, keys: Sequence[str]) -> Column:
    """First key of a struct column of cleaned values that is not null."""
    return F.expr(f"coalesce({', '.join(f'{values}.`{key}`' for key in keys)})")


def first_string(record: Column, keys: Sequence[str]) -> Column:
    """First key of a parsed record with non-blank text, trimmed."""
    return F.coalesce(*[non_blank(record[key]) for key in keys])


def trimmed_fields(record: str, keys: Sequence[str]) -> Column:
    """Struct of the listed fields of a struct column, trimmed, null where blank."""
    parts = ", ".join(f"nullif(btrim({record}.`{key}`, '{BLANKS}'), '') AS `{key}`" for key in keys)
    return F.expr(f"struct({parts})")


def number_fields(record: str, keys: Sequence[str]) -> Column:
    """Struct of the listed fields of a struct column as numbers, by the rule of `to_number`."""
    trimmed = {key: f"btrim({record}.`{key}`, '{BLANKS}')" for key in keys}
    parts = ", ".join(
        f"CASE WHEN {text} RLIKE r'{NUMBER}' THEN try_cast({text} AS DOUBLE) END AS `{key}`"
        for key, text in trimmed.items()
    )
    return F.expr(f"struct({parts})")


def to_number(text: Column) -> Column:
    """Double from feed text, null when it is no plain decimal number.

    `try_cast` alone would also take `1d`, `NaN` and friends.
    """
    trimmed = trim_blanks(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def first_number(record: Column, keys: Sequence[str]) -> Column:
    """First key of a parsed record that holds a number."""
    return F.coalesce(*[to_number(record[key]) for key in keys])


def is_whole(number: Column) -> Column:
    """True for null or a value an INT column can hold without rounding."""
    return number.isNull() | ((number == F.floor(number)) & number.between(-(2**31), 2**31 - 1))


def valid_email(email: Column) -> Column:
    trimmed = trim_blanks(email)
    return F.coalesce(
        (trimmed != "") & trimmed.contains("@") & (F.length(trimmed) <= EMAIL_MAX), F.lit(False)
    )


def normalize_email(email: Column) -> Column:
    return F.lower(trim_blanks(email))
