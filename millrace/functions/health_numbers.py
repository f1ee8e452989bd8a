"""Personal health numbers next to their label, masked or flagged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks

_BEGIN = r"(?=[0-9]{5})(?<![0-9])"
_NUMBER = r"(?:[0-9]{5}\s*-\s*[0-9]{4}|[0-9]{9})(?![0-9])"
_LABEL = r"(?i:(?<![A-Za-z0-9_])PHN(?![A-Za-z0-9_]))"


def pattern(proximity: int = 20) -> str:
    """Nine digits, or five and four around a hyphen, with the label at most ``proximity`` characters before or after,
    none of them a digit or a line end. One pattern, so a replacement can't serve as a label. What stands before is looked
    at only where a number begins."""
    gap = f"[^0-9\\r\\n]{{0,{checks.whole(proximity, 'proximity')}}}"
    return f"{_BEGIN}(?:(?<={_LABEL}{gap}){_NUMBER}|{_NUMBER}(?={gap}{_LABEL}))"


def mask_phn(text: Column, replacement: str = "[PHN]", proximity: int = 20) -> Column:
    if not isinstance(replacement, str):
        raise ValueError("`replacement` must be one non-missing character value.")
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit(pattern(proximity)), F.lit(literal))


def flag_phn(text: Column, proximity: int = 20) -> Column:
    """1 where ``mask_phn`` masks something, else 0; null and blank text give 0."""
    return F.coalesce(F.rlike(text, F.lit(pattern(proximity))), F.lit(False)).cast("int")
