"""Stemming and folding of terms: Porter's algorithm (1980) and ASCII folding.

Both run once per distinct term: of the texts in a search, of some documents when an index is made.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose decomposition keeps no ASCII base letter.
FOLDED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ħ": "h", "ı": "i",
    "ĳ": "ij", "ŀ": "l", "ŋ": "n", "ŧ": "t",
}

# The suffix rules of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)

_WORD = re.compile("[a-z]{3,}")


def fold(term: str) -> str:
    """The term without accents, in ASCII where a letter has such a form."""
    if term.isascii():
        return term
    plain = "".join(FOLDED.get(c, c) for c in term)
    return "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """One letter per letter: v for a vowel, c for a consonant."""
    out = []
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[i - 1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _after_ed_ing(stem: str) -> str:
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c" and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _participle(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return _after_ed_ing(stem) if "v" in _shape(stem) else word
    return word


def _replace(word: str, rules: dict[str, str]) -> str:
    suffix = _longest(word, rules)
    stem = word[: len(word) - len(suffix)]
    return stem + rules[suffix] if suffix and _measure(stem) > 0 else word


def _strip(word: str) -> str:
    suffix = _longest(word, STEP4)
    stem = word[: len(word) - len(suffix)]
    if not suffix or _measure(stem) < 2 or (suffix == "ion" and not stem.endswith(("s", "t"))):
        return word
    return stem


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@lru_cache(maxsize=100_000)
def stem(term: str) -> str:
    """Porter's stem of a lower-case ASCII word; other terms come back as they are."""
    if not _WORD.fullmatch(term):
        return term
    word = _participle(_plural(term))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _tidy(_strip(_replace(_replace(word, STEP2), STEP3)))


def analyzed(term: str) -> str:
    return fold(stem(term))


@F.pandas_udf(T.StringType())
def analyzed_udf(terms: pd.Series) -> pd.Series:
    return terms.map(analyzed)
