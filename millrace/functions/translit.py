"""Latin letters without their accents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
_PLAIN: dict[str, str] = {}
for _code in range(0xC0, 0x250):
    _c = chr(_code)
    _base = "".join(x for x in unicodedata.normalize("NFD", _c) if not unicodedata.combining(x))
    if len(_base) == 1 and _base.isascii() and _base != _c:
        _PLAIN[_c] = _base
_PLAIN |= {k: v for k, v in _SPECIAL.items() if len(v) == 1}
_LONG = {k: v for k, v in _SPECIAL.items() if len(v) > 1}
_TABLE = str.maketrans(_PLAIN | _LONG)


def ascii_text(text: str) -> str:
    return text.translate(_TABLE)


def ascii_column(text: Column) -> Column:
    """The same as a column: one translate and a few replacements."""
    for k, v in _LONG.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))
