"""Problem 8: pages of repeated keywords, link lists or product tags rather than sentences.

Text becomes a sequence of word classes: function words, content words (new or repeated of late, by
the number of those in a row), digits, kinds of punctuation, links.  Windows of it that
carry the marks of sentences, program code or formulas train one trigram model of classes each.
Every window of every document is then scored: it is ordinary if under some model its perplexity is
neither abnormally high nor abnormally low, by the quantiles of that model's own windows.  A page is
spam if more than half of its characters lie in windows that aren't ordinary.

All documents are tokenised once, counted, calibrated and scored; the driver holds trigram counts
and score histograms, whose number is bounded by the number of classes and bins.

Defined cases: every row comes out with a score; null, empty and blank texts have no tokens, a null share
and are not spam; a text of fewer than 4 tokens is spam only if more than half of its characters are links;
repeated rows give repeated rows; a collection without windows to learn from has no other spam; texts and
words of any length are read and weighed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut

WINDOW = 24
MIN_TOKENS = 4
#: A repetition counts if the same word, or run of three characters, stood within so many tokens before.
NEAR = 160
QUANTILES = (0.0005, 0.995)
#: Distances from median to quartile within which a window is ordinary (about three standard deviations).
SPREAD = 4.5
#: Bits that one token adds at most, so that a single odd sign doesn't mark a window.
MOST_BITS = 7.0
#: Weight of the sequence against the single class.
SEQUENCE = 0.5
BATCH_CHARS = 600_000
#: Tokens that are scored at once; a longer text is scored alone.
BATCH_TOKENS = 300_000

# Function words of English; function characters of Chinese; last syllables that mark
# a word of a Korean sentence (particles and endings).
ENGLISH = (
    "a about above after again against all almost also although always am among an and another any anything are as ask at "
    "be because been before behind being below beneath beside between both but by can could did do does down during each "
    "either else ever every few for from had has have he her here hers him his how i if in into is it its just later less "
    "many may me might mine more most much must my near neither never no nobody nor not nothing now of off often on once "
    "one only onto or other our out over own quite rather said same shall she should since so some somewhere still such "
    "than that the their them then there these they this those though through thus to too toward under until up upon us "
    "very was we were what when where which while who whom whose why will with within without would yet you your"
)
CHINESE = "的了在是和不有就也都被把从到与又只它他她你我这那之后里对吗呢吧啊着过地得而但却很更最会要想说问像让给为以于等已将并或若如则且因所其何谁什么怎哪每某些个们上下中前时便才再还没别无非可能"

KOREAN = "은는이가을를에의와과도로서고다며면지만까요네"

_LOWER, _CAPITAL, _LONG, _HAN, _KATA, _HANGUL = range(6)
_CONTENT = 6
_STEPS = 7
#: Content classes: kind x repeated x steps in a row; then the others.
_OTHER = _CONTENT * 2 * _STEPS
(
    FUNC_WORD, FUNC_HAN, HIRAGANA, DIGIT, STOP, COMMA, QUOTE, COLON, HASH, BAR, DOT, CODE, MATH, SYMBOL, LINK, GAP, LINE, SLASH, FUNC_AGAIN, FUNC_HANGUL, ANGLE, START,
) = range(_OTHER, _OTHER + 22)
CLASSES = _OTHER + 22

_URL = re.compile(r"(?:https?://|www\.)[\x21-\x7e]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b(?![(\[_])(?:/[\x21-\x7e]*)?", re.I)
#: Marks of chat and model formats, which are noise here.
_MARK = re.compile(r"<\|[a-z_]{1,30}\|>")
_LINK_SIGN = "\ue000"
# Raw classes of characters.
_R_DROP, _R_SPACE, _R_LINE, _R_LATIN, _R_DIGIT, _R_HAN, _R_HIRA, _R_KATA, _R_HANGUL, _R_LINK, _R_SIGN, _R_END = range(12)
_SIGNS = {
    STOP: ".。．!！?？…‥", COMMA: ",，、;；", QUOTE: "\"'“”‘’「」『』《》〈〉", COLON: ":：", HASH: "#＃", BAR: "|｜", SLASH: "/／", DOT: "・·•*~～-－—–",
    CODE: "(){}[]=+&%@_", ANGLE: "<>＜＞»«›‹→", MATH: "$\\^≤≥×÷√π∑∫",
}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    import unicodedata

    raw, sign = np.full(0x10000, _R_SIGN, np.uint8), np.full(0x10000, SYMBOL, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if c == 0:
            raw[c] = _R_END
        elif c == 10:
            raw[c] = _R_LINE
        elif 0x4E00 <= c < 0xA000 or 0x3400 <= c < 0x4DC0 or c == 0x3005:
            raw[c] = _R_HAN
        elif 0x3040 <= c < 0x30A0:
            raw[c] = _R_HIRA
        elif 0x30A0 <= c < 0x3100 and c != 0x30FB:
            raw[c] = _R_KATA
        elif 0xAC00 <= c < 0xD7B0:
            raw[c] = _R_HANGUL
        elif chr(c) == _LINK_SIGN:
            raw[c] = _R_LINK
        elif kind[0] == "L":
            raw[c] = _R_LATIN
        elif kind[0] == "N":
            raw[c] = _R_DIGIT
        elif kind in ("Cc", "Cf", "Mn") and c not in (9, 13):
            raw[c] = _R_DROP
        elif kind[0] == "Z" or c in (9, 13):
            raw[c] = _R_SPACE
    for name, chars in _SIGNS.items():
        for ch in chars:
            sign[ord(ch)] = name
    return raw, sign


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def _word_hash(word: str) -> int:
    cp = np.array([ord(c) for c in word], dtype=np.uint64)
    return int(_mix(cp * _K1 + np.arange(len(cp), dtype=np.uint64)).sum())


class Classifier:
    """Tokens and their classes for many texts at once."""

    def __init__(self) -> None:
        self.raw, self.sign = _tables()
        self.english = np.sort(np.array([_word_hash(w) for w in ENGLISH.split()], dtype=np.uint64))
        self.han = np.zeros(0x10000, bool)
        self.han[[ord(c) for c in CHINESE]] = True
        self.korean = np.zeros(0x10000, bool)
        self.korean[[ord(c) for c in KOREAN]] = True

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(classes, characters) of the tokens of each text."""
        whole = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
        whole = _MARK.sub(" ", whole)
        whole = _URL.sub(lambda m: _LINK_SIGN * len(m.group()), whole)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        raw = self.raw[np.minimum(cp, 0xFFFF)]
        raw = np.where(cp > 0xFFFF, np.where((cp >= 0x20000) & (cp < 0x32000), _R_HAN, _R_SIGN), raw).astype(np.uint8)
        kept = raw != _R_DROP
        cp, raw = cp[kept], raw[kept]
        doc_of = np.cumsum(raw == _R_END) - (raw == _R_END)
        # One token for each run of letters, digits, kana words, links, spaces, line ends or one sign.
        merges = np.isin(raw, [_R_SPACE, _R_LINE, _R_LATIN, _R_DIGIT, _R_KATA, _R_HANGUL, _R_LINK])
        first = np.ones(len(cp), bool)
        first[1:] = (raw[1:] != raw[:-1]) | ~(merges[1:] | ((raw[1:] == _R_SIGN) & (cp[1:] == cp[:-1])))
        start = np.flatnonzero(first)
        length = np.diff(start, append=len(cp))
        kind, head = raw[start], cp[start]
        tail = cp[start + length - 1]
        low = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint64)
        inside = np.arange(len(cp), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64)
        h = np.add.reduceat(_mix(low * _K1 + inside), start) if len(start) else np.zeros(0, np.uint64)
        # Spaces count only between characters of scripts written without them.
        wide = np.isin(kind, [_R_HAN, _R_HIRA, _R_KATA])
        gap = kind == _R_SPACE
        between = np.zeros(len(kind), bool)
        between[1:-1] = wide[:-2] & wide[2:]
        # The ideographic space counts wherever it doesn't indent a line.
        between[1:] |= (head[1:] == 0x3000) & (kind[:-1] != _R_LINE) & (kind[:-1] != _R_END)
        stays = ~(gap & ~between)
        kind, head, tail, length, h, start = kind[stays], head[stays], tail[stays], length[stays], h[stays], start[stays]
        # A number that opens a line, and the sign behind it, only count the lines.
        mark = self.sign[np.minimum(head, 0xFFFF)]
        opens = np.ones(len(kind), bool)
        opens[1:] = (kind[:-1] == _R_LINE) | (kind[:-1] == _R_END)
        number = np.zeros(len(kind), bool)
        number[:-1] = opens[:-1] & (kind[:-1] == _R_DIGIT) & (kind[1:] == _R_SIGN) & np.isin(mark[1:], [DOT, COLON, STOP, COMMA])
        number[1:] |= number[:-1].copy()
        # A line end counts only where no sentence ends with it.
        closed = np.isin(mark, [STOP, QUOTE]) & (kind == _R_SIGN) | (kind == _R_LINE) | (kind == _R_END)
        ended = np.ones(len(kind), bool)
        ended[1:] = closed[:-1]
        keep = ~number & ~((kind == _R_LINE) & ended)
        kind, head, tail, length, h, start = kind[keep], head[keep], tail[keep], length[keep], h[keep], start[keep]
        doc = doc_of[start]
        n = len(kind)
        out = np.full(n, SYMBOL, np.int16)
        out[kind == _R_SIGN] = self.sign[np.minimum(head[kind == _R_SIGN], 0xFFFF)]
        for k, v in ((_R_SPACE, GAP), (_R_LINE, LINE), (_R_DIGIT, DIGIT), (_R_HIRA, HIRAGANA), (_R_LINK, LINK)):
            out[kind == k] = v
        latin, han = kind == _R_LATIN, kind == _R_HAN
        at = np.minimum(np.searchsorted(self.english, h), len(self.english) - 1)
        word = latin & (self.english[at] == h)
        out[word] = FUNC_WORD
        ending = (kind == _R_HANGUL) & self.korean[np.minimum(tail, 0xFFFF)] & (length > 1)
        out[ending] = FUNC_HANGUL
        sign_han = han & self.han[np.minimum(head, 0xFFFF)]
        out[sign_han] = FUNC_HAN
        # Content words: kind, repeated of late, steps in a row.
        base = np.full(n, -1, np.int16)
        lat = latin & ~word
        base[lat] = np.where(length[lat] > 16, _LONG, np.where((head[lat] >= 65) & (head[lat] <= 90), _CAPITAL, _LOWER))
        base[han & ~sign_han] = _HAN
        base[kind == _R_KATA] = _KATA
        base[(kind == _R_HANGUL) & ~ending] = _HANGUL
        content = base >= 0
        key = h.copy()
        pairs = np.zeros(n, bool)
        pairs[1:] = han[1:] & han[:-1]
        key[1:] = np.where(pairs[1:], _mix(h[1:] * _K1 + h[:-1]), h[1:])
        triples = np.zeros(n, bool)
        triples[2:] = pairs[2:] & pairs[1:-1]
        key[2:] = np.where(triples[2:], _mix(key[2:] * _K1 + h[:-2]), key[2:])
        key = _mix(key + doc.astype(np.uint64) * _K1)
        order = np.argsort(key, kind="stable")
        repeated = np.zeros(n, bool)
        same = (key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] <= NEAR)
        repeated[order[1:][same]] = True
        out[sign_han & repeated & triples] = FUNC_AGAIN
        index = np.arange(n)
        breaks = ~content
        breaks[1:] |= doc[1:] != doc[:-1]
        last = np.maximum.accumulate(np.where(breaks, index, -1)) if n else index
        row = index - last
        row = np.where(content & breaks, 1, row)
        # Repeated ones are told apart by how many content words in a row (signs aside) were repeated.
        nth = np.cumsum(content)
        opens = np.zeros(n, bool)
        opens[1:] = doc[1:] != doc[:-1]
        streak = nth - np.maximum.accumulate(np.where(opens, nth - content, np.where(content & ~repeated, nth, 0))) if n else nth
        step = np.where(
            repeated, np.searchsorted([2, 4, 7, 12, 20, 40], streak, side="left"), np.searchsorted([1, 2, 3, 5, 8, 14], row, side="left")
        )
        out[content] = ((base * 2 + repeated) * _STEPS + step)[content]
        real = kind != _R_END
        out, length, doc = out[real].astype(np.uint8), length[real], doc[real]
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [(out[a:b], length[a:b]) for a, b in zip(ends[:-1], ends[1:])]


_CLASSIFIER: list[Classifier] = []


def classifier() -> Classifier:
    if not _CLASSIFIER:
        _CLASSIFIER.append(Classifier())
    return _CLASSIFIER[0]


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tell = classifier()

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        done = tell(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, key_type),
                pa.array([c.tobytes() for c, _ in done], pa.binary()),
                pa.array([n.astype("<u4").tobytes() for _, n in done], pa.binary()),
            ],
            ["k", "classes", "chars"],
        )

    for b in batches:
        key_type = b.schema.field(0).type
        keys, texts, held = [], [], 0
        for k, t in zip(b.column(0), b.column(1)):
            t = t.as_py() or ""
            keys.append(k.as_py())
            texts.append(t)
            held += len(t)
            if held >= BATCH_CHARS:
                yield work(keys, texts)
                keys, texts, held = [], [], 0
        if keys:
            yield work(keys, texts)


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, classes, chars`` of every row, written once; a null text has no tokens."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return cut(own.mapInArrow(_tokenise, f"k {kind}, classes binary, chars binary"), "classes")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about BATCH_TOKENS tokens, so that memory doesn't follow the size of a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        upto = np.cumsum(pc.binary_length(b.column("classes")).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + BATCH_TOKENS, side="right")))
            yield b.slice(begin, end - begin)
            begin = end


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a batch: trigram codes, classes, characters, window numbers; of each window: its row."""
    held = [np.frombuffer(c, np.uint8) for c in batch.column("classes").to_pylist()]
    n = np.array([len(x) for x in held], dtype=np.int64)
    cls = np.concatenate(held).astype(np.int64) if len(held) else np.zeros(0, np.int64)
    chars = np.frombuffer(b"".join(batch.column("chars").to_pylist()), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
    one = np.where(inside >= 1, np.roll(cls, 1), START)
    two = np.where(inside >= 2, np.roll(cls, 2), START)
    code = (two * CLASSES + one) * CLASSES + cls
    # A last window of under half the length joins the one before it.
    of = np.maximum(1, (n + WINDOW // 2) // WINDOW)
    local = np.minimum(inside // WINDOW, np.repeat(of, n) - 1)
    base = np.cumsum(of) - of
    return code, cls, chars, np.repeat(base, n) + local, np.repeat(np.arange(len(n)), of)


GENRES = 7


def genre_of(cls: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    """For each window the model it trains, -1 for none.

    0 to 3: sentences mainly in Latin letters, Han, kana or Hangul; 4: program code; 5: formulas;
    6: dialogue with speakers.
    """

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(window[mask], minlength=n)

    size = np.maximum(1, np.bincount(window, minlength=n))
    content = cls < _OTHER
    repeated = count(content & (cls // _STEPS % 2 == 1)) / np.maximum(1, count(content))
    spam = count((cls == LINK) | (cls == HASH) | (cls == BAR))
    quotes, colons, stops = count(cls == QUOTE), count(cls == COLON), count(cls == STOP)
    by_script = np.stack([count(cls == FUNC_WORD), count((cls == FUNC_HAN) | (cls == FUNC_AGAIN)), count(cls == HIRAGANA), count(cls == FUNC_HANGUL)])
    words = by_script.sum(axis=0) / size
    code, math = count(cls == CODE), count(cls == MATH)
    whole = size >= WINDOW // 2
    clean = (spam == 0) & (count(cls == DOT) + count(cls == SLASH) <= 3) & (count(cls == GAP) <= 2) & whole
    out = np.full(n, -1)
    out[(spam == 0) & (code >= 3) & (math == 0) & whole] = 4
    out[(math >= 2) & (count(cls == LINK) == 0) & whole] = 5
    sentences = clean & (code + math == 0) & (stops >= 1) & (words >= 0.12) & (repeated <= 0.5)
    out[clean & (code + math == 0) & (colons >= 1) & (quotes + stops >= colons) & (words >= 0.08) & (repeated <= 0.8)] = 6
    sentences &= colons == 0
    out[sentences] = by_script.argmax(axis=0)[sentences]
    return out


def trigram_counts(tokens: DataFrame) -> np.ndarray:
    """Counts [genre, two before, one before, class] over the training windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in _slices(batches):
            code, cls, _, window, rows = _windows(b)
            genre = genre_of(cls, window, len(rows))[window]
            keys, n = np.unique((genre * CLASSES**3 + code)[genre >= 0], return_counts=True)
            for k, m in zip(keys.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["k", "n"])

    # At most GENRES x CLASSES^3 rows, whatever the number of documents.
    rows = tokens.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(GENRES * CLASSES**3, dtype=np.float32)
    out[rows["k"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float32)
    return out.reshape(GENRES, CLASSES, CLASSES, CLASSES)


def surprise(counts: np.ndarray) -> np.ndarray:
    """Bits of each trigram, as float32 [genre, trigram code].

    Half is -log2 of the interpolated trigram probability, half that of the class alone: a long run
    of one rare class is likely once it has begun, but such classes are rare in sentences.
    """
    out = np.empty((GENRES, CLASSES**3), dtype=np.float32)
    for g, c in enumerate(counts):
        three = c / np.maximum(c.sum(axis=2, keepdims=True), 1)
        two = c.sum(axis=0)
        one = two.sum(axis=0)
        one = one / max(1, one.sum())
        two = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
        p = 0.55 * three + 0.3 * two[None] + 0.1 * one + 0.05 / CLASSES
        bits = -SEQUENCE * np.log2(p) - (1 - SEQUENCE) * np.log2(0.98 * one + 0.02 / CLASSES)
        out[g] = np.minimum(bits, MOST_BITS).reshape(-1)
    return out


BINS, BIN = 320, 0.05


def _score(table: np.ndarray, code: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(1, np.bincount(window, minlength=n))
    return np.stack([np.bincount(window, weights=table[g][code], minlength=n) / size for g in range(GENRES)])


def limits(tokens: DataFrame, table) -> np.ndarray:
    """[genre, low and high]: quantiles of the scores of each model's own windows, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GENRES, BINS), dtype=np.int64)
        for b in _slices(batches):
            code, cls, _, window, rows = _windows(b)
            genre = genre_of(cls, window, len(rows))
            score = _score(table.value, code, window, len(rows))
            for g in range(GENRES):
                at = np.minimum((score[g][genre == g] / BIN).astype(np.int64), BINS - 1)
                total[g] += np.bincount(at, minlength=BINS)
        g, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), pa.array(total[g, k], pa.int64())], ["g", "b", "n"])

    out = np.zeros((GENRES, BINS))
    for r in tokens.mapInArrow(run, "g bigint, b bigint, n bigint").groupBy("g", "b").agg(F.sum("n").alias("n")).collect():
        out[r[0], r[1]] = r[2]
    bounds = np.zeros((GENRES, 2))
    for g in range(GENRES):
        upto = np.cumsum(out[g]) / max(1, out[g].sum())
        low, q25, q50, q75, high = (np.searchsorted(upto, q) * BIN for q in (QUANTILES[0], 0.25, 0.5, 0.75, QUANTILES[1]))
        # Quartiles aren't moved by the few windows that only look like the genre.
        bounds[g] = max(low, q50 - SPREAD * (q50 - q25)), min(high, q50 + SPREAD * (q75 - q50)) + BIN
        if not out[g].sum():
            bounds[g] = 0, -1
    return bounds


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tokens, share, links, perplexity`` of every row: share of a text's characters in windows that aren't ordinary.

    ``links`` is the share of its characters in links, ``perplexity`` that of the whole text under the model
    that fits it best.  Both shares and the perplexity are null for a text without tokens.
    """
    sc = docs.sparkSession.sparkContext
    tokens = tokenised(docs, key, text)
    table = sc.broadcast(surprise(trigram_counts(tokens)))
    bounds = limits(tokens, table)
    untaught = bool((bounds[:, 1] < 0).all())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            code, cls, chars, window, rows = _windows(b)
            score = _score(table.value, code, window, len(rows))
            fits = ((score >= bounds[:, :1]) & (score <= bounds[:, 1:])).any(axis=0) | untaught
            weight = np.bincount(window, weights=chars, minlength=len(rows))
            all_ = np.bincount(rows, weights=weight, minlength=b.num_rows)
            odd = np.bincount(rows, weights=weight * ~fits, minlength=b.num_rows)
            size = np.bincount(rows, weights=np.bincount(window, minlength=len(rows)), minlength=b.num_rows)
            bits = np.stack([np.bincount(rows, weights=score[g] * np.bincount(window, minlength=len(rows)), minlength=b.num_rows) for g in range(GENRES)]).min(axis=0)
            linked = np.bincount(rows[window], weights=chars * (cls == LINK), minlength=b.num_rows)
            none = size == 0
            shares = [pa.array(x, mask=none) for x in (odd / np.maximum(1, all_), linked / np.maximum(1, all_), 2 ** (bits / np.maximum(1, size)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), *shares], ["k", "tokens", "share", "links", "perplexity"])

    kind = docs.schema[key].dataType.simpleString()
    out = tokens.mapInArrow(run, f"k {kind}, tokens bigint, share double, links double, perplexity double")
    return out.withColumnRenamed("k", key)


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` of the pages with more than half of their characters in windows that aren't ordinary, or in links where they are short."""
    return scored(docs, key, text).filter(f"(share > 0.5 and tokens >= {MIN_TOKENS}) or (links > 0.5 and tokens < {MIN_TOKENS})").select(key)
