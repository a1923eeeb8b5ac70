"""Porter's stemmer (M. F. Porter, 1980), and the search tokenizer built on it."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.runtime import ship

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_M0 = re.compile(f"^(?:{_C})?{_V}{_C}")
_M1 = re.compile(f"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(f"^(?:{_C})?{_V}{_C}{_V}{_C}")
_VOWEL = re.compile(f"^(?:{_C})?{_V.split('[aeiou]*')[0]}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")

# Suffixes of the algorithm's second and third step and what replaces them.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
# Suffixes that the fourth step drops.
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), None)


@functools.lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of two letters and words in other scripts stay."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M0.match(w[:-3]):
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if cut is not None and re.search("[aeiouy]", cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
            elif _CVC.match(w):
                w += "e"
    if w.endswith("y") and re.search("[aeiouy]", w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _M0.match(w[: -len(s)]):
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s:
        if _M2.match(w[: -len(s)]):
            w = w[: -len(s)]
    elif re.search("[st]ion$", w) and _M2.match(w[:-3]):
        w = w[:-3]
    if w.endswith("e"):
        base = w[:-1]
        if _M2.match(base) or (_M1.match(base) and not _CVC.match(base)):
            w = base
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return w.lower()


_token = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Letters and digits, without case and accents, stemmed."""
    if not text:
        return []
    bare = text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    return [stem(t) for t in _token.findall(bare.lower())]


def stemmed_tokens(text: Column) -> Column:
    """The stemmed words of a text, by Arrow batches: the stemmer rewrites a word step by step."""
    ship()

    @F.pandas_udf("array<string>")
    def stems(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return stems(text)


def plain_tokens(text: Column) -> Column:
    """Lower-case words without stemming: an expression, for corpora where stems are not wanted."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
