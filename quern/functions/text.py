"""Text expressions on the JVM side that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in Unicode or for Python's str.isspace, as a class body.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def narrow(c: Column) -> Column:
    """Full-width ASCII forms and the ideographic space as the plain characters."""
    return F.translate(c, _WIDE, _PLAIN)


def strip(c: Column) -> Column:
    """Without white space at the ends, as Python's str.strip."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space only."""
    return c.isNull() | ~c.rlike(f"[^{SPACE}]")


def pages_in_order(texts: Column) -> Column:
    """Array of (page INT, text) of the non-empty pages of a map page number -> (words, text), in numeric order.

    Keys that are no number come last, in the order of the keys; a null map gives null.
    """
    pages = F.filter(F.map_entries(texts), lambda e: e["value"]["text"].isNotNull() & (e["value"]["text"] != ""))
    keyed = F.transform(
        pages,
        lambda e: F.struct(
            F.coalesce(e["key"].try_cast("int"), F.lit(2147483647)).alias("order"),
            e["key"].alias("key"),
            e["value"]["text"].alias("text"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].try_cast("int").alias("page"), e["text"].alias("text")))


def whole_text(texts: Column, joint: str = "\n\n") -> Column:
    """The non-empty pages of a map in numeric order, joined; null for a null map."""
    return F.array_join(F.transform(pages_in_order(texts), lambda e: e["text"]), joint)
