"""Text clean-up and tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_NOISE = str.maketrans({"'": " ", '"': " ", "\n": " ", "%": " "})
_BLANKS = " \t\n\r\x0b\x0c"
_SPACES = re.compile(f"[{_BLANKS}]+")


def to_plain_ascii(text: str) -> str:
    """Compatibility-decompose and keep what is ASCII."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def tidy(text: str) -> str:
    """One clean line: ASCII, no quotes or percent signs, single spaces."""
    return _SPACES.sub(" ", to_plain_ascii(text).translate(_NOISE).strip(_BLANKS))


@pandas_udf(StringType())
def _plain_ascii(text: pd.Series) -> pd.Series:
    return text.map(to_plain_ascii, na_action="ignore")


def one_line(plain: Column) -> Column:
    """Plain text without quotes and percent signs, with single spaces."""
    spaced = F.translate(plain, "'\"\n%", "    ")
    return F.regexp_replace(F.regexp_replace(spaced, r"^\s+|\s+$", ""), r"\s+", " ")


def clean_text(text: Column) -> Column:
    """``tidy`` as a Column; only the decomposition runs in Python, in Arrow batches."""
    return one_line(_plain_ascii(text))


def _phrases(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words; the words are taken once for each of the n, not for each run."""
    runs = F.size(words) - (n - 1)
    whole = F.slice(words, 1, F.greatest(runs, F.lit(0)))
    for k in range(1, n):
        after = F.slice(words, k + 1, F.greatest(runs, F.lit(0)))
        whole = F.zip_with(whole, after, lambda head, word: F.concat(head, F.lit(" "), word))
    return F.coalesce(whole, F.array().cast("array<string>"))


def sequences(text: Column, size: Column) -> Column:
    """All runs of ``size`` neighbouring characters, in one pass over the text, however long it is."""
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), 1)


def tokens(text: Column, max_words: int = 1) -> Column:
    """Lower-case whitespace tokens; with ``max_words`` above 1 also the longer phrases."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    if max_words == 1:
        return words
    return F.concat(words, *[_phrases(words, n) for n in range(2, max_words + 1)])
