"""A linkage identifier from name, birth date and gender."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dates
from .translit import ascii_column

INVALID = "Invalid SID"
#: One alternation of all forms; no text has two of them. Only month before day is tried before day before month.
_FORMS = (
    r"(?s)^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{4})/(\d{1,2})/(\d{1,2})|(\d{4})(\d{2})(\d{2})|(\d{1,2})/(\d{1,2})/(\d{4})"
    r"|(\d{1,2})-([A-Za-z]{3,9})-(\d{4})|([A-Za-z]{3,9}) (\d{1,2}), (\d{4})).*$"
)
_PARTS = ("$1$4$7", "$2$5$8", "$3$6$9", "$10", "$11", "$12", "$13$17", "$14$16", "$15$18")


def birth_digits(dob: Column, kind: T.DataType) -> Column:
    """YYYYMMDD of a date, a timestamp, or text and numbers by the first form that fits, value by value."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(dob.cast("date"), "yyyyMMdd")
    t = F.btrim(dob.cast("string"))
    t = F.regexp_replace(t, r"\.0$", "") if isinstance(kind, T.NumericType) else t

    def read(f: Column) -> Column:
        one, two, year = dates.int_part(f, 3), dates.int_part(f, 4), dates.int_part(f, 5)
        y = F.coalesce(dates.int_part(f, 0), year, dates.int_part(f, 8))
        m = F.coalesce(dates.int_part(f, 1), one, dates.month_number(F.get(f, F.lit(7))))
        d = F.coalesce(dates.int_part(f, 2), two, dates.int_part(f, 6))
        make = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date")
        return F.coalesce(make(y, m, d), F.when(year.isNotNull(), make(year, two, one)))

    return F.date_format(dates.let(dates.split_match(t, _FORMS, _PARTS), lambda f: F.when(F.size(f) > 1, read(f))), "yyyyMMdd")


def linkage_id(first_name: Column, last_name: Column, dob: Column, gender: Column, *, dob_type: T.DataType, strip_accents: bool = False) -> Column:
    """First two letters of either name, the birth date and the gender's first character, in capitals; "Invalid SID"
    where a part is missing. Each birth date is read by itself. It is no secure hash: people can be found from it."""

    def letters(name: Column) -> Column:
        t = F.btrim(name.cast("string"))
        t = F.regexp_replace(ascii_column(t) if strip_accents else t, "[^A-Za-z]", "")
        return F.when(F.length(t) >= 2, F.upper(F.substring(t, 1, 2)))

    g = F.upper(F.substring(F.btrim(gender.cast("string")), 1, 1))
    parts = [letters(first_name), letters(last_name), birth_digits(dob, dob_type), F.when(g != "", g)]
    return F.coalesce(F.concat(*parts), F.lit(INVALID))
