"""Byte-level BPE with a public vocabulary: ids or sizes of every text of a column.

Each pre-token is merged over a segment tree.  A leaf holds ``rank * width + position`` of the pair
that starts there; the root is therefore the leftmost pair of lowest rank.  A merge changes three
leaves, each in logarithmic time, so a run of n bytes takes O(n log n) whatever it holds.

Two things keep the tree off the common path, both exact.  (1) No merge crosses two neighbouring
bytes that stand side by side in no entry of the vocabulary; pre-tokens outside ASCII are cut there,
which leaves mostly single characters.  (2) A worker remembers the ids of the short pieces it has
met.  The memory is bounded by emptying it; results don't depend on it.

Defined cases: a null or empty text has no ids (an empty list, size 0).  Strings that look like
special tokens are ordinary text.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pattern that cuts text into pre-tokens before the merges of this vocabulary,
#: with white space spelt as the Unicode property.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
CACHE_ENTRIES = 400_000
#: Texts of one Arrow batch are encoded in slices of about so many characters, to bound memory.
SLICE_CHARS = 2_000_000


def vocabulary_bytes(directory: str = DEFAULT_DIR, name: str = DEFAULT_NAME) -> bytes:
    """The rank file of a public vocabulary, as it is."""
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by a segment tree over the ranks of its neighbouring pairs."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [ranks[piece]]
    width = 1 << (n - 1).bit_length()
    none = width * (1 << 40)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(leaf: int, value: int) -> None:
        k = width + leaf
        if tree[k] == value:
            return
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] < none:
        i = tree[1] % width
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k
        put(j, none)
        if k < n:
            before[k] = i
            r = get(parts[i] + parts[k])
            put(i, none if r is None else r * width + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(parts[h] + parts[i])
            put(h, none if r is None else r * width + h)
    return [ranks[p] for p in parts if p is not None]


def _bmp_pattern() -> str:
    """``PRETOKEN`` for texts without characters beyond U+FFFF, with the properties spelt out as classes."""
    import regex

    bmp = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def chars(prop: str) -> str:
        runs = (m.group() for m in regex.finditer(f"{prop}+", bmp))
        return "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" for r in runs)

    letters, numbers, space = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\p{White_Space}")
    return (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


class _Memory(dict):
    """Piece -> its ids as little-endian int32 bytes; a missing piece is encoded."""

    def __init__(self, encode, keep: int, longest: int) -> None:
        self.encode, self.keep, self.longest = encode, keep, longest

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encoder of one vocabulary; lives as long as its Python worker."""

    def __init__(self, raw: bytes) -> None:
        import regex

        self.ranks = parse_ranks(raw)
        #: Bytes of each id.
        self.lengths = np.zeros(max(self.ranks.values(), default=-1) + 1, dtype=np.int64)
        for token, i in self.ranks.items():
            self.lengths[i] = len(token)
        joined = {t[i : i + 2] for t in self.ranks for i in range(len(t) - 1)}
        # Last byte of a character -> first bytes that may be merged with it.
        self.joins = [frozenset(b for b in range(256) if bytes((a, b)) in joined) for a in range(256)]
        self.units = _Memory(self._unit, CACHE_ENTRIES, 8)
        self.pieces = _Memory(self._piece, CACHE_ENTRIES, 12)
        self.find_any = regex.compile(PRETOKEN).findall
        self.find_bmp = re.compile(_bmp_pattern()).findall
        self.han = re.compile("[\u4e00-\u9fff]+").fullmatch
        self.astral = re.compile("[\U00010000-\U0010ffff]").search
        pairs = self._joined_han()
        esc = re.escape
        self.joined_han = re.compile(b"|".join(esc(a + b) for a, b in pairs) or b"(?!)").search
        joined = b"|".join(esc(a) + b"(?=" + esc(b) + b")" for a, b in pairs) or b"(?!)"
        self.han_units = re.compile(b"(?:..(?:" + joined + b"))*...", re.S).findall

    def _joined_han(self) -> list[tuple[bytes, bytes]]:
        """Of characters U+4E00 to U+9FFF (three bytes each): last and first bytes that may be merged."""
        return [
            (bytes((last,)), bytes((first,)))
            for last in range(0x80, 0xC0)
            for first in sorted(self.joins[last])
            if 0xE4 <= first <= 0xE9
        ]

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text; the faster of two equal patterns where it has no character beyond U+FFFF."""
        return self.find_bmp(text) if self.astral(text) is None else self.find_any(text)

    def _unit(self, unit: str) -> bytes:
        return np.array(merge(unit.encode(), self.ranks), dtype="<i4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """A pre-token, cut where no merge can cross."""
        if piece.isascii():
            return self._unit(piece)
        if self.han(piece):
            raw = piece.encode()
            if self.joined_han(raw) is None:
                return b"".join(map(self.units.__getitem__, piece))
            return b"".join([self.units[u.decode()] for u in self.han_units(raw)])
        joins, units, out = self.joins, self.units, []
        start, last = 0, None
        for at, c in enumerate(piece):
            o = ord(c)
            if o < 0x80:
                first = end = o
            elif o < 0x800:
                first, end = 0xC0 | o >> 6, 0x80 | o & 0x3F
            elif o < 0x10000:
                first, end = 0xE0 | o >> 12, 0x80 | o & 0x3F
            else:
                first, end = 0xF0 | o >> 18, 0x80 | o & 0x3F
            if last is not None and first not in last:
                out.append(units[piece[start:at]])
                start = at
            last = joins[end]
        out.append(units[piece[start:]])
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian int32 bytes."""
        return b"".join(map(self.pieces.__getitem__, self.find(text))) if text else b""

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()

    def size(self, text: str | None) -> int:
        return len(self.encode(text)) // 4


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for a vocabulary; built once."""
    key = hashlib.md5(raw).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows with a bounded number of characters, and where they begin."""
    start, held, chars = 0, [], 0
    for i in range(len(texts)):
        t = texts[i].as_py()
        held.append(t)
        chars += len(t) if t else 0
        if chars >= SLICE_CHARS:
            yield start, held
            start, held, chars = i + 1, [], 0
    if held:
        yield start, held


def encode(
    df: DataFrame, key: str, text: str, out: str = "ids", directory: str = DEFAULT_DIR, name: str = DEFAULT_NAME
) -> DataFrame:
    """``key`` and the ids of ``text`` for every row, as ``out ARRAY<INT>``.

    Only the two columns reach Python.  The vocabulary (under 1 MB) is the only thing broadcast.
    Null keys, repeated rows and repeated texts are kept as they are; other columns may have any
    name, since only the two are read.
    """
    raw = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(directory, name))
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                coded = [enc.encode(t) for t in texts]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int64).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], ["k", "v"])

    schema = T.StructType([T.StructField("k", key_type), T.StructField("v", T.ArrayType(T.IntegerType()))])
    coded = df.select(F.col(key).alias("k"), F.col(text).alias("v")).mapInArrow(run, schema)
    return coded.select(F.col("k").alias(key), F.col("v").alias(out))


def sizes(
    df: DataFrame, key: str, text: str, out: str = "tokens", directory: str = DEFAULT_DIR, name: str = DEFAULT_NAME
) -> DataFrame:
    """``key`` and the number of ids of ``text`` for every row, as ``out BIGINT``; ids never leave the worker."""
    raw = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(directory, name))
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            n = [enc.size(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["k", "v"])

    schema = T.StructType([T.StructField("k", key_type), T.StructField("v", T.LongType())])
    coded = df.select(F.col(key).alias("k"), F.col(text).alias("v")).mapInArrow(run, schema)
    return coded.select(F.col("k").alias(key), F.col("v").alias(out))


def decode(spark: SparkSession, df: DataFrame, ids: str, out: str = "text", directory: str = DEFAULT_DIR, name: str = DEFAULT_NAME) -> DataFrame:
    """Adds the text that a list of ids stands for (bytes that are no text become U+FFFD); null for null."""
    raw = spark.sparkContext.broadcast(vocabulary_bytes(directory, name))

    @F.pandas_udf(T.StringType())
    def back(column):
        enc = encoder(raw.value)
        if not hasattr(enc, "pieces_of"):
            enc.pieces_of = {i: b for b, i in enc.ranks.items()}
        look = enc.pieces_of
        return column.map(lambda v: None if v is None else b"".join(look[int(i)] for i in v).decode(errors="replace"))

    return df.withColumn(out, back(F.col(ids)))
