"""Features of stored web pages.

The markup is taken apart with column functions, for which a page is a plain
string; Python decodes character references and accents alone. The texts of a page
go there and back as one string for each feature, as lists of strings are slow to
hand over.
"""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from auctionlens.functions.text import tidy
from auctionlens.schemas import PAGE_FEATURES

#: What the reader never sees: comments, scripts and styles; one that is not closed lasts to the end.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: The attributes of a tag. A ">" between quotes does not end it; the loop gives nothing back, so it needs no stack.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\z)"""
ANY_TAG = rf"(?is)</?[a-z]{_ATTRIBUTES}|<![^>]*+(?:>|\z)"
#: Elements whose start or end closes an open paragraph.
BLOCKS = (
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul"
).split()


def start_tag(name: str) -> str:
    return rf"(?is)<{name}(?:[\s/]{_ATTRIBUTES}|>|\z)"


def attribute(name: str) -> str:
    """Group 1 is the value, with its quotes."""
    return rf"""(?i)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def rest_after(names: list[str], slash: str = "/") -> str:
    """From an end tag (with ``/?`` also a start tag) of one of the names on."""
    return rf"(?is)<{slash}(?:{'|'.join(names)})\b.*"


#: Stands before each text of a string that goes to Python; pages have none of it.
MARK = "\x00"


def _behind_first(pieces: Column) -> Column:
    """All elements but the first; a length from the array itself would have it computed twice."""
    return F.slice(pieces, 2, 1 << 30)


def _texts(readable: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A function of array columns that gives every text's readable form, without those that have none."""

    @pandas_udf(StringType())
    def convert(joined: pd.Series) -> pd.Series:
        each = (map(readable, texts.split(MARK)[1:]) for texts in joined)
        return pd.Series(["".join([MARK + t for t in texts if t is not None]) for texts in each], dtype=object)

    def column(texts: Column) -> Column:
        joined = F.array_join(F.transform(texts, lambda t: F.concat(F.lit(MARK), t)), "")
        return _behind_first(F.split(convert(joined), MARK))

    return column


def _named(text: str) -> str | None:
    text = unescape(text).strip()
    return tidy(text) if text and not text.isdigit() else None


_decoded = _texts(unescape)
_plain = _texts(lambda text: tidy(unescape(text)))
_plain_named = _texts(_named)


def _elements(page: Column, name: str, end: str) -> Column:
    """The text of every element of a name, up to ``end`` or to the next such element."""
    return F.transform(
        _behind_first(F.split(page, start_tag(name))),
        lambda x: F.regexp_replace(F.regexp_replace(x, end, ""), ANY_TAG, ""),
    )


def _values(tags: Column, name: str) -> Column:
    return F.transform(tags, lambda tag: F.regexp_extract(tag, attribute(name), 1))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _meta(metas: Column, prefix: str) -> Column:
    """The content of the last meta element that has one and whose name begins so; an array of one or none."""
    pairs = F.filter(
        F.arrays_zip(_values(metas, "name").alias("name"), _values(metas, "content").alias("content")),
        lambda m: F.lower(_unquoted(m["name"])).startswith(prefix) & (m["content"] != ""),
    )
    return F.transform(F.slice(F.reverse(pairs), 1, 1), lambda m: _unquoted(m["content"]))


def page_features(pages: DataFrame) -> DataFrame:
    """One record per page (``page_id``, ``url``, ``html``)."""
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1))
    seen = pages.where("html IS NOT NULL").select(
        "page_id", host.alias("domain"), F.replace(F.regexp_replace("html", UNSEEN, ""), F.lit(MARK), F.lit("\ufffd")).alias("page")
    )
    page = F.col("page")
    metas = F.regexp_extract_all("page", F.lit(start_tag("meta")), 0)
    alts = _values(F.regexp_extract_all("page", F.lit(start_tag("img")), 0), "alt")
    parts = seen.select(
        "page_id",
        "domain",
        _plain(F.slice(_elements(page, "title", rest_after(["title"])), 1, 1)).alias("title"),
        _plain(_meta(metas, "descr")).alias("meta_description"),
        _decoded(_meta(metas, "keywords")).alias("meta_keywords"),
        _plain_named(_elements(page, "a", rest_after(["a"]))).alias("ref_titles"),
        _plain_named(F.transform(alts, _unquoted)).alias("img_alt_titles"),
        _plain(_elements(page, "p", rest_after(BLOCKS, "/?"))).alias("content"),
    )
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")).alias(c)
    words = F.flatten(F.transform("meta_keywords", lambda k: F.split(k, r"\s+")))
    words = F.transform(F.array_remove(words, ""), lambda w: F.regexp_replace(w, "^,+|,+$", ""))
    return parts.select(
        "page_id", "domain", first("title"), first("meta_description"), words.alias("meta_keywords"),
        "ref_titles", "img_alt_titles", "content",
    ).select(PAGE_FEATURES.fieldNames())


def page_anchor_counts(features: DataFrame) -> DataFrame:
    """How often each title or link term occurs per domain."""
    texts = F.concat(F.array("title"), "ref_titles")
    words = F.flatten(F.transform(texts, lambda t: F.split(F.lower(t), " ")))
    return (
        features.select("domain", F.explode_outer(words).alias("term"))
        .where("term <> ''")
        .groupBy("domain", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
