"""Column helpers where Spark's own function differs from the SQL meant here.

All of them build expressions; none is a UDF. Where Spark has the exact
function (``coalesce``, ``nullif``, ``trim``, ``make_date``, ...) use that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"


def as_money(column: Column) -> Column:
    return column.cast(MONEY)


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL when whole is 0 or NULL."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


# --- predicates ---------------------------------------------------------------


def optional_equals(column: Column, value) -> Column | None:
    """A predicate, or None when the parameter was not given."""
    return None if value is None else column == F.lit(value)


def all_of(*predicates: Column | None) -> Column:
    """AND of the predicates that were given."""
    combined = F.lit(True)
    for predicate in predicates:
        if predicate is not None:
            combined = combined & predicate
    return combined


def flag_not_set(flag: Column, keep_null: bool) -> Column:
    """"not 1" on a three-valued flag; NULL is kept or dropped as said."""
    return ~flag | flag.isNull() if keep_null else ~F.coalesce(flag, F.lit(True))


def equals_ignoring_case(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def equals_ignoring_trailing_space(left: Column, right: Column) -> Column:
    return F.rtrim(left) == F.rtrim(right)


# --- text ---------------------------------------------------------------------


def concat_null_as_empty(*parts: Column) -> Column:
    """CONCAT(): a NULL part counts as the empty string."""
    return F.concat(*[F.coalesce(part.cast("string"), F.lit("")) for part in parts])


def text_length(column: Column) -> Column:
    """LEN(): characters without trailing spaces."""
    return F.length(F.rtrim(column))


def stuff(column: Column, start: int, length: int, insert: str) -> Column:
    """STUFF(): NULL when start lies outside the text."""
    replaced = F.overlay(column, F.lit(insert), F.lit(start), F.lit(length))
    return F.when((F.lit(start) >= 1) & (F.lit(start) <= F.length(column)), replaced)


def pattern_position(pattern: str, column: Column) -> Column:
    """PATINDEX with a regular expression: 1-based, 0 when absent."""
    return F.regexp_instr(column, F.lit(pattern))


def currency(amount: Column, code: str = "USD") -> Column:
    return F.concat(F.lit(f"{code} "), F.format_number(amount, 2))


# Fixed value: the e-mail pattern, applied to the whole text.
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"


def is_email(column: Column) -> Column:
    return column.rlike(EMAIL_PATTERN)


def email_user(column: Column) -> Column:
    return F.split_part(column, F.lit("@"), F.lit(1))


def email_domain(column: Column) -> Column:
    return F.split_part(column, F.lit("@"), F.lit(2))


def split_csv_int(csv: Column, extra_separators: bool = False) -> Column:
    """Integers of a comma-separated text, in order, duplicates kept.

    CR and LF are removed; with ``extra_separators`` they and ``;`` separate
    as well. Blank tokens, non-integers and integers beyond 32 bits are
    dropped; NULL gives an empty array.
    """
    text = F.coalesce(csv, F.lit(""))
    text = F.translate(text, "\n\r;", ",,,") if extra_separators else F.translate(text, "\n\r", "")
    tokens = F.transform(F.split(text, ","), lambda token: F.trim(token))
    whole = F.filter(tokens, lambda token: token.rlike(r"^[+-]?\d+$"))
    return F.filter(F.transform(whole, lambda token: token.try_cast("int")), lambda n: n.isNotNull())


# --- dates --------------------------------------------------------------------


def months_crossed(start: Column, end: Column) -> Column:
    """DATEDIFF(month): month boundaries between the two dates."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def years_crossed(start: Column, end: Column) -> Column:
    return F.year(end) - F.year(start)


def end_of_month(column: Column, offset: int = 0) -> Column:
    return F.last_day(F.add_months(column, offset))


def is_date(column: Column) -> Column:
    return F.try_to_date(column).isNotNull()


def age_days(day: Column, as_of=None) -> Column:
    """Days from ``day`` to ``as_of``, which is the clock's day by default."""
    return F.datediff(F.current_date() if as_of is None else F.lit(as_of), day)
