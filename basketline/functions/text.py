"""Expressions that turn text cells into typed values. Each gives null for unusable text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketline import schema


def starts_between(text: Column, first: str, last: str) -> Column:
    """Whether the first character is one of an ASCII range. Texts compare by bytes, which no pattern is needed for."""
    return (text >= F.lit(first)) & (text < F.lit(chr(ord(last) + 1)))


def stripped(cell: Column) -> Column:
    """Strip Unicode white space from both ends; cells that start and end visibly, as nearly all do, skip the search."""
    cell = cell.cast("string")
    tidy = starts_between(cell, "!", "~") & starts_between(F.substring(cell, -1, 1), "!", "~")
    return F.when(tidy, cell).otherwise(F.btrim(cell, F.lit(schema.WHITESPACE)))


def normalized(cell: Column) -> Column:
    """Strip, and turn empty text into null."""
    return F.nullif(stripped(cell), F.lit(""))


def to_whole_number(text: Column) -> Column:
    """Read normalized text as a 64-bit whole number; `6.0` and `6e0` count as whole."""
    real = F.when(text.rlike(schema.NUMERIC_PATTERN), text.try_cast("double"))
    whole = (real == F.floor(real)) & (real >= F.lit(-(2.0**63))) & (real < F.lit(2.0**63))
    digits = F.when(text.rlike(schema.DIGITS_PATTERN), text.try_cast("bigint"))
    return F.coalesce(digits, F.when(whole, real.try_cast("bigint")))


def to_finite_number(text: Column) -> Column:
    """Read normalized text as a finite double."""
    real = F.when(text.rlike(schema.NUMERIC_PATTERN), text.try_cast("double"))
    return F.when(F.abs(real) < F.lit(float("inf")), real)


def to_customer_id(cell: Column) -> Column:
    """Keep the digits of an id such as `17850` or `17850.0`; takes the cell as it was read."""
    digits = F.nullif(F.regexp_extract(cell, schema.CUSTOMER_ID_PATTERN, 1), F.lit(""))
    return F.when(cell.rlike(schema.BARE_ID_PATTERN), cell).otherwise(digits)


def to_timestamp_any(text: Column) -> Column:
    """Read a date by the layout that its shape calls for; other shapes are not even tried."""
    flat = F.translate(text, "/", "-")

    def shaped(cell: Column, shape: str, layout: str) -> Column:
        return F.when(cell.rlike(shape), F.try_to_timestamp(cell, F.lit(layout)))

    # The first layout is put in the order that a plain cast reads, which is much quicker than a format.
    month_day, year = F.substring_index(text, "/", 2), F.substring_index(F.substring_index(text, " ", 1), "/", -1)
    turned = F.concat(year, F.lit("-"), F.replace(month_day, F.lit("/"), F.lit("-")), F.lit(" "), F.substring_index(text, " ", -1))
    others = F.coalesce(
        shaped(flat, schema.OTHER_DATE_SHAPE, schema.OTHER_DATE_FORMAT),
        shaped(flat, schema.DAY_FIRST_SHAPE, schema.DAY_FIRST_FORMAT),
    )
    primary = F.when(text.rlike(schema.PRIMARY_DATE_SHAPE), turned.try_cast("timestamp_ntz"))
    return F.coalesce(primary, others.cast("timestamp_ntz"))


def is_formula(cell: Column) -> Column:
    """True where a cell starts like a spreadsheet formula and is not a signed number."""
    # No formula starts with a digit or letter, nor with what stands between ":" and "<", or between "A" and the end of ASCII.
    harmless = starts_between(cell, "0", "<") | starts_between(cell, "A", "\x7f")
    unsafe = cell.rlike(schema.FORMULA_PATTERN) & ~cell.rlike(schema.SIGNED_NUMBER_PATTERN)
    return F.when(harmless, F.lit(False)).otherwise(F.coalesce(unsafe, F.lit(False)))
