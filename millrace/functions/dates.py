"""Dates and date-times from text and numbers of many shapes.

Text: missing words are null; a trailing Z or UTC offset is dropped, not applied; what follows a recognised date or
time is ignored; AM and PM are ignored unless ``honor_ampm``. Shapes are tried with seconds, then with minutes, then as
dates alone; in each round year-first before the ambiguous ones before month names. Dropping an offset also takes the
year from a dash date that ends in it ("05-01-2024"), which then is null; with a time it parses.
Numbers ("auto"): YYYYMMDD, YYYYMMDDHHMM, YYYYMMDDHHMMSS; Unix seconds from 1e8; Excel days 30000 to 60000; days since
1970 above -100000 and below 30000. All of it is built-in expressions on the JVM; parts that are used more than once are
bound in a higher-order function, which keeps the plan small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import checks

ORIGINS = ("auto", "excel", "unix", "r")
MISSING_WORDS = ("na", "n/a", "null", "none")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in _MONTHS) + ")"


def meaningful(text: Column) -> Column:
    """True for text that is neither null, blank nor a word for missing."""
    t = F.btrim(text)
    return F.coalesce((t != "") & ~F.lower(t).isin(*MISSING_WORDS), F.lit(False))


#: What parts of a match are set apart by; a text's own ones are taken for another control character.
_MARK, _OTHER = "\u0001", "\u0002"
#: One alternation of all shapes; at most one can match a text. Groups: 1-4 year first, 5-7 compact, 8-11 ambiguous, 12-14 day and
#: month name, 15-17 month name and day, 18 what follows.
_SHAPE = (
    r"(?s)^\s*(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{4})(\d{2})(\d{2})(?=$|[T\s])|(\d{1,2})([-/.])(\d{1,2})\9(\d{4})"
    rf"|(\d{{1,2}})(?:-|\s*)({_MONTH})(?:-|\s*)(\d{{1,4}})|({_MONTH})\s*(\d{{1,2}}),\s*(\d{{1,4}}))(.*)$"
)
_SHAPE_PARTS = ("$1", "$5", "$3$6", "$4$7", "$8", "$10", "$11", "$12$16", "$13$15", "$14$17", "$18")
_TIME = r"(?s)^(T|\s*)(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?(.*)$"
_TIME_PARTS = ("$1", "$2", "$3", "$4", "$5")


def split_match(t: Column, pattern: str, parts: tuple[str, ...]) -> Column:
    """Array of ``parts`` of the text's one match, all from one run of the pattern; an array of the text alone without a match."""
    marked = F.regexp_replace(F.translate(t, _MARK, _OTHER), F.lit(pattern), F.lit(_MARK.join(parts)))
    return F.split(marked, _MARK, len(parts))


def int_part(parts: Column, n: int) -> Column:
    c = F.get(parts, F.lit(n))
    return F.when(c != "", c.try_cast("int"))


def month_number(name: Column) -> Column:
    spot = F.array_position(F.array(*[F.lit(x[:3]) for x in _MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(spot > 0, spot.cast("int"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _make(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.try_make_timestamp(y, m, d, h, mi, s)


def _read(f: Column, w: Column, day_first: bool, honor_ampm: bool) -> Column:
    """Timestamp from the parts of the shape and of the time behind it: with seconds, with minutes, as a date alone; of
    ambiguous ones either reading is tried before the next of these."""
    zero, none = F.lit(0), F.lit(0).cast("decimal(16,6)")
    one, two, year = int_part(f, 4), int_part(f, 5), int_part(f, 6)
    if day_first:
        one, two = two, one
    y = F.coalesce(int_part(f, 0), int_part(f, 1), year, int_part(f, 9))
    m = F.coalesce(int_part(f, 2), one, month_number(F.get(f, F.lit(8))))
    d = F.coalesce(int_part(f, 3), two, int_part(f, 7))
    compact, rest = F.get(f, F.lit(1)) != "", F.get(f, F.lit(10))
    iso = compact | (F.get(f, F.lit(0)) != "")
    h, mi = int_part(w, 1), int_part(w, 2)
    usable = (h < 24) & (iso | (F.get(w, F.lit(0)) != "T"))
    second = F.get(w, F.lit(3)).try_cast("decimal(16,6)")
    at = h
    if honor_ampm:
        tail = F.lower(F.get(w, F.lit(4)))
        at = F.when(tail.rlike(r"^\s*pm") & (h < 12), h + 12).when(tail.rlike(r"^\s*am") & (h == 12), zero).otherwise(h)
    by_minute = F.when(F.get(w, F.lit(3)) == "", at).otherwise(h)  # AM and PM are read right behind what is used
    usable_at = (F.when(at < 24, True)) & usable if honor_ampm else usable
    tries = []
    for ok, hour, sec in ((usable_at & second.isNotNull(), at, second), (usable, by_minute, none), (~compact | (rest == ""), zero, none)):
        minute = zero if hour is zero else mi
        tries += [F.when(ok, _make(y, m, d, hour, minute, sec)), F.when(ok & year.isNotNull(), _make(year, two, one, hour, minute, sec))]
    return F.coalesce(*tries)


def local_from_text(text: Column, *, day_first: bool = False, honor_ampm: bool = False) -> Column:
    """Wall-clock timestamp (in UTC) of text, without the numeric shapes."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(text), "Z$", ""), "([+-][0-9]{2}:?[0-9]{2})$", ""))
    timed = lambda f: let(split_match(F.get(f, F.lit(10)), _TIME, _TIME_PARTS), lambda w: _read(f, w, day_first, honor_ampm))
    parsed = let(split_match(t, _SHAPE, _SHAPE_PARTS), lambda f: F.when(F.size(f) > 1, timed(f)))
    return F.when(meaningful(text), parsed)


def _compact(digits: Column) -> Column:
    at = lambda a, n: F.substring(digits, a, n).try_cast("int")
    zero = F.lit(0)
    size = F.length(digits)
    h = F.when(size >= 12, at(9, 2)).otherwise(zero)
    mi = F.when(size >= 12, at(11, 2)).otherwise(zero)
    s = F.when(size == 14, at(13, 2)).otherwise(zero)
    return F.when(size.isin(8, 12, 14) & (h < 24), _make(at(1, 4), at(5, 2), at(7, 2), h, mi, s.cast("decimal(16,6)")))


def _whole_digits(x: Column) -> Column:
    whole = F.abs(x - F.rint(x)) < 1.4901161193847656e-08
    return F.when(whole & (F.abs(x) < 1e15), F.abs(F.rint(x)).cast("decimal(20,0)").cast("string"))


def _instant(seconds: Column) -> Column:
    return F.when(F.abs(seconds) < 2e11, F.timestamp_micros((seconds * 1_000_000).cast("long")))


def _numeric(x: Column, origin: str, tz: str) -> Column:
    x = x.cast("double")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    excel, unix, days = _instant((x - 25569) * 86400), _instant(x), _instant(x * 86400)
    if origin != "auto":
        return {"excel": excel, "unix": unix, "r": days}[origin]
    compact = _compact(_whole_digits(x))
    compact = compact if tz == "UTC" else F.to_utc_timestamp(compact, tz)
    rest = F.when((x >= 1e8) & (x <= 4102444800), unix).when((x >= 30000) & (x <= 60000), excel).when((x > -1e5) & (x < 30000), days)
    return F.coalesce(compact, rest)


def _checked(kind: T.DataType, day_first: bool, origin: str, tz: str) -> None:
    checks.flag(day_first, "day_first")
    checks.choice(origin, "numeric_origin", ORIGINS)
    checks.label(tz, "tz")
    if not isinstance(kind, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError("`x` must be a date, timestamp, text or numeric column.")


def to_datetime(x: Column, kind: T.DataType, *, day_first: bool = False, numeric_origin: str = "auto", tz: str = "UTC", honor_ampm: bool = False) -> Column:
    """A timestamp (an instant; wall-clock text is read in ``tz``). ``kind`` is the column's type. Session time zone UTC."""
    _checked(kind, day_first, numeric_origin, tz)
    utc = lambda c: c if tz == "UTC" else F.to_utc_timestamp(c, tz)
    if isinstance(kind, T.TimestampType):
        return x
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return utc(x.cast("timestamp"))
    if isinstance(kind, T.NumericType):
        return _numeric(x, numeric_origin, tz)
    t = F.btrim(x)
    number = F.when(meaningful(x) & t.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(utc(local_from_text(x, day_first=day_first, honor_ampm=honor_ampm)), let(number, lambda n: _numeric(n, numeric_origin, tz)))


def to_date(x: Column, kind: T.DataType, *, day_first: bool = False, numeric_origin: str = "auto", tz: str = "UTC") -> Column:
    """The date in ``tz``; a date column passes as it is."""
    _checked(kind, day_first, numeric_origin, tz)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return x.cast("date")
    at = to_datetime(x, kind, day_first=day_first, numeric_origin=numeric_origin, tz=tz)
    return (at if tz == "UTC" else F.from_utc_timestamp(at, tz)).cast("date")
