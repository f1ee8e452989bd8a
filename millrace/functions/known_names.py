"""Names supplied in columns of the same row, masked or flagged in a text: exactly, or within an edit distance."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks

PLACEHOLDERS = ("ANONYMOUS", "N/A", "NA", "NONE", "NOT APPLICABLE", "NOT AVAILABLE", "NOT PROVIDED", "NULL", "UNIDENTIFIED", "UNK", "UNKNOWN")
_NEVER = "(?!)"
_TOKEN = r"\p{Alpha}+(?:[-']\p{Alpha}+)*"


def _clean(name: Column) -> Column:
    return F.regexp_replace(F.btrim(name.cast("string")), r"\s+", " ")


def _usable(value: Column) -> Column:
    letters = F.length(F.regexp_replace(value, r"[^\p{Alpha}]", ""))
    return F.coalesce((letters >= 2) & ~F.upper(value).isin(*PLACEHOLDERS), F.lit(False))


def _escaped(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"([\]\[{}()+*^$|\\?.])", r"\\$1"), r"\s+", r"\\s+")


def name_pattern(names: Sequence[Column]) -> Column:
    """The row's regular expression, null where it has no usable name: the full name, the last before the others, or any
    one part; none of them inside a longer word."""
    values = [_clean(n) for n in names]
    usable = [_usable(v) for v in values]
    parts = [F.when(u, _escaped(v)).otherwise(F.lit(_NEVER)) for u, v in zip(usable, values)]
    every, some = usable[0], usable[0]
    for u in usable[1:]:
        every, some = every & u, some | u
    full = F.when(every, F.concat_ws(r"\s+", *parts)).otherwise(F.lit(_NEVER))
    comma = F.when(every, F.concat(parts[-1], F.lit(r"\s*,\s*"), F.concat_ws(r"\s+", *parts[:-1]))).otherwise(F.lit(_NEVER)) if len(parts) > 1 else F.lit(_NEVER)
    edge = r"[\p{Alnum}_'-]"
    return F.when(some, F.concat(F.lit(f"(?i)(?<!{edge})(?:"), F.concat_ws("|", full, comma, *parts), F.lit(f")(?!{edge})")))


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _normal(token: Column) -> Column:
    """A token's letters in lower case; tokens have no accents."""
    return F.translate(F.lower(token), "-'", "")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)), _normal))


def _near(token: Column, known: Column, distance: int) -> Column:
    return F.exists(known, lambda k: F.levenshtein(token, k, distance) >= 0)


def _known_tokens(names: Sequence[Column], min_chars: int) -> Column:
    values = [_clean(n) for n in names]
    lists = [F.when(_usable(v), _tokens(v)).otherwise(F.array().cast("array<string>")) for v in values]
    return F.filter(F.array_distinct(F.concat(*lists)), lambda t: F.length(t) >= min_chars)


def _checked(df: DataFrame, text: str, name_columns: Sequence[str], max_distance: int = 0, min_chars: int = 5) -> list[Column]:
    checks.frame(df, "data")
    checks.column(df, text, "text")
    names = list(dict.fromkeys([name_columns] if isinstance(name_columns, str) else name_columns))
    if not names:
        raise ValueError("`name_columns` must name at least one column.")
    for n in names:
        checks.column(df, n, "name_columns")
    if not 0 <= checks.whole(max_distance, "max_distance") <= 3:
        raise ValueError("`max_distance` must be one integer from 0 to 3.")
    checks.whole(min_chars, "min_chars", 2)
    return [checks.q(n) for n in names]


def _filled(text: Column) -> Column:
    return F.coalesce(F.btrim(text) != "", F.lit(False))


def exact_mask(text: Column, names: Sequence[Column], replacement: str) -> Column:
    """``replacement`` is a template of the regular expression, as $ and backslash are."""
    p = name_pattern(names)
    return F.when(_filled(text) & p.isNotNull(), F.regexp_replace(text, p, F.lit(replacement))).otherwise(text)


def exact_flag(text: Column, names: Sequence[Column]) -> Column:
    p = name_pattern(names)
    return F.when(_filled(text) & p.isNotNull(), F.rlike(text, p).cast("int")).otherwise(F.lit(0))


def similar_mask(text: Column, names: Sequence[Column], replacement: str, max_distance: int, min_chars: int) -> Column:
    """Words within ``max_distance`` of a known one are replaced; the text is rebuilt from its words and what lies between."""
    least = max(2, min_chars - max_distance)
    own = [re.sub("[-']", "", t.lower()) for t in re.findall("[A-Za-z]+(?:[-'][A-Za-z]+)*", replacement)]
    words = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    between = F.split(text, _TOKEN, -1)

    def masked(known: Column) -> Column:
        hit = lambda t: (F.length(t) >= least) & ~t.isin(own) & _near(t, known, max_distance)
        put = F.transform(words, lambda w: F.when(_with(_normal(w), hit), F.lit(replacement)).otherwise(w))
        pieces = F.zip_with(between, F.concat(put, F.array(F.lit(""))), lambda b, w: F.concat(b, w))
        return F.when(F.size(known) > 0, F.array_join(pieces, "")).otherwise(text)

    return F.when(_filled(text), _with(_known_tokens(names, min_chars), masked)).otherwise(text)


def similar_flag(text: Column, names: Sequence[Column], max_distance: int, min_chars: int) -> Column:
    least = max(2, min_chars - max_distance)

    def found(known: Column) -> Column:
        hit = F.exists(_tokens(text), lambda t: (F.length(t) >= least) & _near(t, known, max_distance))
        return F.when(F.size(known) > 0, hit.cast("int")).otherwise(F.lit(0))

    return F.when(_filled(text), _with(_known_tokens(names, min_chars), found)).otherwise(F.lit(0))


def mask_known_names(df: DataFrame, text: str, name_columns: Sequence[str] = ("first_name", "last_name"), *, replacement: str = "[NAME]", max_distance: int = 1, min_chars: int = 5, output: str = "masked_text") -> DataFrame:
    """``df`` with ``output``: the text without the row's own names, exact first, then similar ones."""
    names = _checked(df, text, name_columns, max_distance, min_chars)
    exact = exact_mask(checks.q(text), names, replacement)
    return df.withColumn(output, exact).withColumn(output, similar_mask(checks.q(output), names, replacement, max_distance, min_chars))


def flag_known_names(df: DataFrame, text: str, name_columns: Sequence[str] = ("first_name", "last_name"), *, max_distance: int = 1, min_chars: int = 5, output: str = "name_flag") -> DataFrame:
    """``df`` with ``output``: 1 where the text has one of the row's own names, exactly or similarly spelt."""
    names = _checked(df, text, name_columns, max_distance, min_chars)
    t = checks.q(text)
    return df.withColumn(output, F.when(exact_flag(t, names) == 1, 1).otherwise(similar_flag(t, names, max_distance, min_chars)))
