"""Text functions as columns. All patterns are valid in Java and in RE2."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Glyphs that some fonts export wrongly, and what they stand for (fixed values).
GLYPH_REPAIRS = {"Ɵ": "ti", "Ʃ": "tt", "ﬁ": "fi", "ﬀ": "ff", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "’": "'"}
#: Invisible operators and zero-width characters (fixed values).
INVISIBLE = "\u2061\u2062\u2063\u2064\u200b\ufeff"


#: White space that goes: after a hyphen at a line's end, and before a small letter that goes on with a word (fixed values).
BROKEN_WORDS = (r"(?<=-)\s*\n\s*", r"(?<=-)\s+(?=[a-z])")


def normalize(text: Column) -> Column:
    """Glyphs repaired, words joined over hyphenated line breaks, white space collapsed."""
    for broken, fixed in GLYPH_REPAIRS.items():
        text = F.replace(text, F.lit(broken), F.lit(fixed))
    for space in BROKEN_WORDS:
        text = F.regexp_replace(text, space, "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def plain(text: Column) -> Column:
    """One line without the marks of raised and lowered runs."""
    text = F.regexp_replace(text, r"[\^_]\{([^}]*)\}", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\^_]", ""), r"\s+", " "))


def preview(text: Column, chars: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, chars)


#: What single characters become: compatibility forms of mathematical letters and of ligatures, a plain blank and h, nothing.
_PLAIN = {c: unicodedata.normalize("NFKC", chr(c)) for low, high in ((0x1D400, 0x1D7FF), (0xFB00, 0xFB06)) for c in range(low, high + 1)}
_PLAIN |= {0xA0: " ", ord("ℎ"): "h"} | dict.fromkeys(map(ord, INVISIBLE))


def clean_unicode(text: str | None) -> str | None:
    """Invisible operators go; mathematical letters and ligatures become plain ones; marks are composed."""
    return None if text is None else unicodedata.normalize("NFC", text.translate(_PLAIN))


@F.pandas_udf(StringType())
def unicode_clean(text: pd.Series) -> pd.Series:
    return text.map(clean_unicode, na_action="ignore")


def number_text(value: Column) -> Column:
    """A number as short as it goes: without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"0+$", ""), r"\.$", "")
