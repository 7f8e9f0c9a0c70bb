"""Entities and tags."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import strip

#: Entities that occur in most pages; the ampersand comes last.
COMMON = (
    ("&nbsp;", " "), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
)


#: An ampersand that may begin an entity beyond the common ones.
_RARE = r"&(?!(?:" + "|".join(name[1:-1] for name, _ in COMMON) + r");)[#A-Za-z]"


@F.pandas_udf(T.StringType())
def unescape_all(column: pd.Series) -> pd.Series:
    """Every named and numeric entity, as Python's html.unescape."""
    return column.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def unescape(c: Column) -> Column:
    """Every entity: on the JVM where a text has only common ones; only the other texts' content reaches Python."""
    common = c
    for name, sign in COMMON:
        common = F.replace(common, F.lit(name), F.lit(sign))
    return F.coalesce(unescape_all(F.when(c.rlike(_RARE), c)), common)


def clean_html(c: Column) -> Column:
    """Text of an HTML fragment; '' for null.

    In order: entities (hence escaped tags go too), images to their alternative text, other tags away (their
    bodies stay, those of scripts and styles too), three or more line ends to two, runs of spaces to one,
    white space at the ends away.
    """
    c = unescape(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"""<img[^>]*alt=["']([^"']*)["'][^>]*>""", "$1")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r" {2,}", " ")
    return strip(c)
