"""Terms of texts by language, for comparing them: words without stop words, stemmed; characters where no spaces part words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import SPACE

#: English stop words; marks are gone before they are looked for.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now cannot could ought would"
)

_VOWELS = "aeiou"


def _form(word: str) -> str:
    """A word as c and v, y being a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c"


def _short(word: str) -> bool:
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


# Suffixes and what they become, by the published algorithm.
_SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The longest suffix that fits decides."""
    for end, to in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + to if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of an English word in lower case, by Porter's algorithm (1980); other words come out as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _form(word[: -len(e)])), "")
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _SECOND), _THIRD)
    end = max((e for e in _FOURTH if word.endswith(e)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda v: None if v is None else [porter(w) for w in v])


def words_of(text: Column, stop: str = STOP) -> Column:
    """Lower-case words without marks and without stop words; an empty array for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{SPACE}]", "")
    return F.filter(F.split(plain, f"[{SPACE}]+"), lambda w: (w != "") & ~w.isin(stop.split()))


def signs_of(text: Column) -> Column:
    """Han and kana characters one by one, other letters and digits in runs; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\P{L}]+|\p{N}+"), F.lit(0))


def terms(text: Column, lang: Column, stop: str = STOP, stemmed: bool = True) -> Column:
    """Terms by language: characters for zh and ja (no segmenter is at hand), else words, stemmed if asked for."""
    words = words_of(text, stop)
    wide = F.coalesce(F.lower(lang).rlike("^(zh|ja)"), F.lit(False))
    return F.when(wide, signs_of(text)).otherwise(stems(F.when(~wide, words)) if stemmed else words)
