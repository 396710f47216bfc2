"""Text-to-typed coercion as column expressions (no UDFs)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# plain decimal / scientific number, after trimming
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# dates are ISO (yyyy-MM-dd...) or month-first (M/d/yyyy...); bare numbers
# such as '45000' are not dates
ISO_DATE_PATTERN = (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
                    r"(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-5][0-9](?:\.[0-9]{1,6})?)[0-9]*Z?)?)?$")
US_DATE_PATTERN = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?: ([0-9]{1,2}):([0-9]{2})(?::([0-5][0-9]))?)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Trim every kind of leading/trailing whitespace (tabs, newlines too)."""
    return F.regexp_replace(_col(c).cast("string"), r"^\s+|\s+$", "")


def normalize_identifier(c) -> Column:
    """Identifier as trimmed text; blank / 'nan' -> null; '123.0' -> '123'."""
    s = strip_ws(c)
    cleaned = F.when(s.rlike(r"^[0-9]+\.0$"), F.regexp_replace(s, r"\.0$", "")).otherwise(s)
    return F.when((s == "") | (F.lower(s) == "nan"), F.lit(None).cast("string")).otherwise(cleaned)


def coerce_numeric(c) -> Column:
    """Text -> double; anything that is not a plain number, or too large for one, becomes null."""
    s = strip_ws(c)
    number = s.try_cast(DoubleType())
    return F.when(s.rlike(NUMBER_PATTERN) & (F.abs(number) < float("inf")), number)


def coerce_timestamp(c) -> Column:
    """Text -> timestamp_ntz: ISO (a fraction and Z allowed) or month-first dates with an optional time; anything else
    (including impossible dates) -> null. The wall-clock parts are taken as written, whatever the session's zone."""
    s = strip_ws(c)

    def parsed(pattern: str, year: int, month: int, day: int) -> Column:
        part = lambda i, kind: F.regexp_extract(s, pattern, i).try_cast(kind)
        zero = lambda i, kind: F.coalesce(part(i, kind), F.lit(0).cast(kind))
        made = F.try_make_timestamp_ntz(part(year, "int"), part(month, "int"), part(day, "int"),
                                        zero(4, "int"), zero(5, "int"), zero(6, "decimal(8,6)"))
        return F.when(s.rlike(pattern), made)

    return F.coalesce(parsed(ISO_DATE_PATTERN, 1, 2, 3), parsed(US_DATE_PATTERN, 3, 1, 2))
