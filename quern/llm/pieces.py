"""Problem 4: oversized items cut into pieces within a limit, at natural boundaries where there are any.

Each item gets the prefix sums of its units (code points, UTF-8 bytes, words, or tokens of a public
tokenizer by their offsets) and the sorted array of its boundaries.  A piece ends at the last boundary
within the limit, found by binary search, or, where there is none beyond the end of the piece before, at
the limit itself (a hard cut).  The next piece begins the overlap before that end.

Tokens of a part of a text needn't be the part of its tokens, so a piece in tokens is encoded by itself and
ends earlier where it doesn't fit; every piece is within the limit when it is encoded alone.

Defined cases: null and empty items give no piece; an item within the limit is one piece (in code points it
never reaches Python); every piece holds at least one new character, even if that alone exceeds the limit
(the overlap gives way first); repeated rows give repeated pieces, unless ``once`` drops them before; an
item with several texts gives the pieces of each; columns beyond the three aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import whole_text
from quern.llm import bpe

LIMIT = 2000
OVERLAP = 100
#: A boundary lies behind each of these, and behind a full stop before white space.
BOUNDARY = re.compile(r"[\n。！？!?…；]|\.(?=\s)")
WORD = re.compile(r"[぀-ヿ㐀-鿿가-힣]|\w+|[^\w\s]")
SCHEMA = "kind string, item_id string, piece int, begin int, end int, hard boolean, chars int, stretch int"
TOKEN_LIMIT, TOKEN_OVERLAP = 512, 32


def boundaries(text: str) -> np.ndarray:
    """Sorted positions of the natural boundaries, the end included."""
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return np.array(ends, dtype=np.int64)


def prefix_sums(text: str, unit: str, enc: bpe.Encoder | None = None) -> np.ndarray:
    """Units that begin before each position; one more entry than characters.  Tokens need an encoder."""
    n = len(text)
    if unit == "chars":
        return np.arange(n + 1, dtype=np.int64)
    if unit in ("bytes", "tokens"):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        each = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    elif unit == "words":
        each = np.zeros(n, dtype=np.int64)
        each[np.fromiter((m.start() for m in WORD.finditer(text)), dtype=np.int64)] = 1
    else:
        raise ValueError(f"unit {unit!r} is none of chars, bytes, words, tokens")
    sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(each)])
    if unit != "tokens":
        return sums
    lengths = enc.lengths[np.frombuffer(enc.encode(text), "<i4")]
    # First byte of each token; a character may hold several, a token several characters.
    return np.searchsorted(np.cumsum(lengths) - lengths, sums, side="left")


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars", enc: bpe.Encoder | None = None) -> tuple[list[tuple[int, int, bool]], int]:
    """(begin, end, hard) of the pieces of a text, and its longest stretch without boundary in units."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n = len(text)
    if not n:
        return [], 0
    sums = prefix_sums(text, unit, enc)
    ends = boundaries(text)
    stretch = int(np.diff(sums[ends], prepend=0).max())
    if int(sums[-1]) <= limit:
        return [(0, n, False)], stretch
    alone = enc.size if unit == "tokens" else None
    sorted_ends = ends.tolist()
    out, begin, done, room = [], 0, 0, limit
    while True:
        most = int(np.searchsorted(sums, sums[begin] + room, side="right")) - 1
        most = min(n, max(most, done + 1))
        k = bisect_right(sorted_ends, most) - 1
        end = sorted_ends[k] if k >= 0 else 0
        hard = end <= done
        if hard:
            end = most
        if alone is not None:
            over = alone(text[begin:end]) - limit
            if over > 0 and (end > done + 1 or begin < done):
                if end > done + 1:
                    room = max(0, min(room, int(sums[end] - sums[begin])) - over)
                else:
                    begin, room = begin + 1, limit
                continue
        out.append((begin, end, hard))
        if end >= n:
            return out, stretch
        # The overlap gives way where one more character wouldn't fit behind it.
        back = max(int(np.searchsorted(sums, sums[end] - overlap, side="left")), int(np.searchsorted(sums, sums[end + 1] - limit, side="left")))
        begin, done, room = max(min(end, back), begin + 1), end, limit


def cut_items(
    items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "chars", oversized_only: bool = False, with_text: bool = False,
    directory: str = bpe.DEFAULT_DIR, name: str = bpe.DEFAULT_NAME,
) -> DataFrame:
    """Pieces of ``items`` (kind, item_id, text): ``kind, item_id, piece, begin, end, hard, chars, stretch`` and, if asked for, ``text``.

    ``begin`` and ``end`` are code points.  Items within the limit in code points are handled on the
    JVM (for other units every item is measured).  ``stretch`` is the item's longest run without
    boundary, null for items that need no cut.  The vocabulary of the unit tokens (under 1 MB) is broadcast.
    """
    plain = items.select("kind", "item_id", "text").filter("text is not null and text <> ''")
    n = F.length("text")
    raw = items.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(directory, name)) if unit == "tokens" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(raw.value) if raw is not None else None
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        names = ["kind", "item_id", "piece", "begin", "end", "hard", "chars", "stretch", "text"]
        if not with_text:
            kinds, names = kinds[:-1], names[:-1]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                cuts, stretch = spans(text, limit, overlap, unit, enc)
                if oversized_only and len(cuts) == 1:
                    continue
                kind, item = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                rows += [(kind, item, k, x, y, h, len(text), stretch, *([text[x:y]] if with_text else [])) for k, (x, y, h) in enumerate(cuts)]
                held += len(text)
                if with_text and held >= 4_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    long = plain.filter(n > limit) if unit == "chars" else plain
    cut = long.mapInArrow(run, SCHEMA + (", text string" if with_text else ""))
    if unit != "chars" or oversized_only:
        return cut
    short = plain.filter(n <= limit).select(
        "kind", "item_id", F.lit(0).alias("piece"), F.lit(0).alias("begin"), n.alias("end"), F.lit(False).alias("hard"),
        n.alias("chars"), F.lit(None).cast("int").alias("stretch"), *(["text"] if with_text else []),
    )
    return cut.unionByName(short)


def once(items: DataFrame) -> DataFrame:
    """Each text of an item once, told apart by 128 bits."""
    return items.withColumns({f"_h{i}": F.xxhash64(F.lit(i), "text") for i in (1, 2)}).dropDuplicates(["kind", "item_id", "_h1", "_h2"]).select("kind", "item_id", "text")


def corpus_items(articles: DataFrame, novels: DataFrame) -> DataFrame:
    """``kind, item_id, text`` of articles and novels; rows without an id are left out."""
    a = articles.select(F.lit("article").alias("kind"), F.col("cvid").cast("string").alias("item_id"), F.col("content").alias("text"))
    b = novels.select(F.lit("novel").alias("kind"), F.col("meta.id").alias("item_id"), whole_text(F.col("texts")).alias("text"))
    return a.unionByName(b).filter("item_id is not null")


def found(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``kind, item_id, need`` of the items that had to be cut, and of those no boundaries could do for."""
    whole = cut_items(items, limit, overlap, oversized_only=True).filter("piece = 0")
    need = F.when(F.col("stretch") > limit, F.array(F.lit("oversized"), F.lit("unbroken"))).otherwise(F.array(F.lit("oversized")))
    return whole.select("kind", "item_id", F.explode(need).alias("need")).distinct()
