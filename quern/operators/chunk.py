"""Texts into chunks of bounded tokens: paragraphs, lines, sentences, hard cuts, then next-fit."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that end a sentence.
ENDS = "。！？…；!?;.\n"
_SENTENCE = re.compile(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+")


class Tokenizer(Protocol):
    def count(self, text: str) -> int: ...


class CharTokenizer:
    """A token is a character; counts add up."""

    def count(self, text: str) -> int:
        return len(text)


class RegexTokenizer:
    """A token is a word, or one other sign that isn't white space."""

    def __init__(self, pattern: str = r"\w+|[^\w\s]") -> None:
        self.pattern = re.compile(pattern)

    def count(self, text: str) -> int:
        return sum(1 for _ in self.pattern.finditer(text))


class FileTokenizer:
    """A tokenizer.json of the tokenizers library, loaded once per worker; strings of its special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        self.path, self.own = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "own": None}

    def count(self, text: str) -> int:
        if self.own is None:
            from tokenizers import Tokenizer as Loaded

            self.own = Loaded.from_file(self.path)
            self.own.encode_special_tokens = True
        return len(self.own.encode(text, add_special_tokens=False).ids)


def sentences(text: str) -> list[str]:
    """Cut behind every sentence end; nothing is lost."""
    return _SENTENCE.findall(text)


def sentence_array(c: Column) -> Column:
    """The same on the JVM side."""
    return F.filter(F.split(c, "(?<=[。！？…；!?;.\n])", -1), lambda x: x != "")


def hard_cut(text: str, tokens: Tokenizer, most: int) -> list[str]:
    """The longest prefixes within the limit, at least one character each; counts are taken to grow with the prefix.

    The prefix is looked for in a window that doubles until it holds more than the limit, so a long text
    isn't counted whole for each piece.
    """
    out, at = [], 0
    while at < len(text):
        window, rest = 2 * most, len(text) - at
        while window < rest and tokens.count(text[at : at + window]) <= most:
            window *= 2
        n = bisect_right(range(1, min(window, rest) + 1), most, key=lambda k: tokens.count(text[at : at + k]))
        out.append(text[at : at + max(n, 1)])
        at += max(n, 1)
    return out


def _with_separator(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    return [p for p in [p + separator for p in parts[:-1]] + parts[-1:] if p]


def chunk_text(text: str, tokens: Tokenizer, most: int, by_sentence: bool = True) -> list[str]:
    """Chunks of at most ``most`` tokens where the tokenizer's counts add up; joined they are the text."""
    blocks: list[str] = []
    for paragraph in _with_separator(text, "\n\n"):
        if tokens.count(paragraph) <= most:
            blocks.append(paragraph)
            continue
        for line in _with_separator(paragraph, "\n"):
            if tokens.count(line) <= most:
                blocks.append(line)
                continue
            for piece in sentences(line) if by_sentence else [line]:
                blocks += [piece] if tokens.count(piece) <= most else hard_cut(piece, tokens, most)
    out, held, n = [], "", 0
    for block in blocks:
        size = tokens.count(block)
        whole = n + size
        # Near the limit the sum of the counts is replaced by the count of the whole.
        if held and 0.9 * most < whole <= most:
            whole = tokens.count(held + block)
        if held and whole > most:
            out.append(held)
            held, whole = "", size
        held += block
        n = whole
    return [*out, held] if held else out


def chunks(df: DataFrame, keys: list[str], text: str, tokens: Tokenizer, most: int, by_sentence: bool = True) -> DataFrame:
    """``keys, split, tokens, text``: one row a chunk; null and empty texts give none.  Filters belong before it."""
    own = df.select(*keys, F.col(text).alias("_text")).filter("_text is not null and _text <> ''")
    fields = ", ".join(f"{k} {t}" for k, t in own.dtypes if k != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, split, size, texts = [], [], [], []
            for i in range(b.num_rows):
                for k, piece in enumerate(chunk_text(b.column(len(keys))[i].as_py(), tokens, most, by_sentence)):
                    rows.append(i)
                    split.append(k)
                    size.append(tokens.count(piece))
                    texts.append(piece)
            at = pa.array(rows, pa.int32())
            cols = [b.column(j).take(at) for j in range(len(keys))]
            cols += [pa.array(split, pa.int32()), pa.array(size, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "split", "tokens", "text"])

    return own.mapInArrow(run, f"{fields}, split int, tokens int, text string")


def pack_lines(texts: list[str], title: str, tokens: Tokenizer, most: int, least: int) -> list[str]:
    """Lines of a book packed up to the limit, each sample with the title in front.

    A sample's size is that of the title and a blank line and of its lines, each counted by itself; lines
    without tokens are left out.  At the end of each text what is held is given out if it has ``least``
    tokens with the title; else a blank line goes on with the next text.  What remains at the end is given out.
    """
    head = f"{title}\n\n"
    base = tokens.count(head)
    out, held, n = [], [], base

    def give() -> None:
        nonlocal held, n
        out.append(head + "\n".join(held).strip())
        held, n = [], base

    for text in texts:
        for line in text.split("\n"):
            size = tokens.count(line)
            if held and n + size > most:
                give()
            n += size
            if size:
                held.append(line)
        if n >= least:
            if held:
                give()
        elif held:
            held.append("")
    if held:
        give()
    return out


def packed_books(df: DataFrame, key: str, title: str, texts: str, tokens: Tokenizer, most: int, least: int) -> DataFrame:
    """``key, sample, tokens, text``: the samples of each book, ``texts`` being the array of its texts in order.

    Null titles are ''; null texts are left out; a null array gives no sample.
    """
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.filter(F.col(texts), lambda x: x.isNotNull()).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A book at a time, so that memory holds one and its samples.
            for k, t, x in zip(*(c.to_pylist() for c in b.columns)):
                made = pack_lines(x, t, tokens, most, least) if x else []
                sizes = pa.array([tokens.count(m) for m in made], pa.int32())
                n = pa.array(range(len(made)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(made), b.schema.field(0).type), n, sizes, pa.array(made, pa.string())], ["k", "sample", "tokens", "text"])

    kind = dict(own.dtypes)["k"]
    return own.mapInArrow(run, f"k {kind}, sample int, tokens int, text string").withColumnRenamed("k", key)
