"""Reading Roman names as people wrote them: parts, spelling keys and a true edit metric."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import numpy as np

# The forenames and their usual abbreviations.
PRAENOMINA = {
    "A": "aulus", "Ap": "appius", "C": "gaius", "Cn": "gnaeus", "D": "decimus", "L": "lucius", "M": "marcus", "M'": "manius", "N": "numerius",
    "P": "publius", "Q": "quintus", "Ser": "servius", "Sex": "sextus", "Sp": "spurius", "T": "titus", "Ti": "tiberius",
}
# Other ways to abbreviate or to spell them.
OTHER_PRAENOMINA = {"g": "C", "gn": "Cn", "mn": "M'", "m’": "M'", "app": "Ap", "serv": "Ser", "sext": "Sex", "tib": "Ti", "caius": "C", "cnaeus": "Cn", "leucius": "L", "maarcus": "M", "cointus": "Q", "poplius": "P", "sporius": "Sp", "nomerius": "N", "seruius": "Ser", "seroius": "Ser", "gnaius": "Cn", "gnaios": "Cn"}
# Greek letters in Latin spelling; pairs first.
GREEK_PAIRS = {"ου": "u", "αυ": "au", "ευ": "eu", "γγ": "ng", "γκ": "nc", "γχ": "nch"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i c l m n x o p r s s t u f ch ps o".split()))
# Words of descent.
DESCENT = {"f", "n", "filius", "filia", "nepos", "υιος", "υ", "l", "lib"}

_code = re.compile(r"^[A-Z]{2,6}\d{3,7}\s+")
_same = re.compile(r"\(\s*=\s*([^)]*)\)")
_bracket = re.compile(r"\([^)]*\)")
_marks = re.compile(r"[\[\]{}<>?!†*;:\"“”„]")


class Name(NamedTuple):
    """Parts of a name: forename as its usual abbreviation, spelling keys of the others, whether the nomen is cut short, gender."""

    praenomen: str | None
    nomen: str | None
    cut: bool
    cognomen: str | None
    gender: str | None
    filiation: str | None


def latin(text: str) -> str:
    """Lower-case Latin letters without accents; Greek spelled in Latin."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    if any("Ͱ" <= c <= "Ͽ" for c in text):
        for a, b in GREEK_PAIRS.items():
            text = text.replace(a, b)
        text = "".join(GREEK.get(c, c) for c in text)
    return text


@functools.lru_cache(maxsize=200_000)
def spelling(word: str, whole: bool = True) -> str:
    """The spelling key of a word: v is u, j and y are i, k is c, ph is f, and so on; double letters count once; the ending -os is
    -us (not of a word cut short, which has no ending)."""
    w = re.sub(r"[^a-z]", "", latin(word))
    w = re.sub(r"([^uv])\1+", r"\1", w)
    w = re.sub(r"e?y$", "i", w) if whole else w
    for a, b in (("ph", "f"), ("th", "t"), ("ch", "c"), ("rh", "r"), ("v", "u"), ("w", "u"), ("j", "i"), ("y", "i"), ("k", "c"), ("z", "s")):
        w = w.replace(a, b)
    return re.sub(r"os$", "us", w) if whole else w


@functools.lru_cache(maxsize=200_000)
def praenomen(word: str | None) -> str | None:
    """A forename, abbreviated or not, Latin or Greek, with or without its dot, as its usual abbreviation; null if it is none."""
    if not word:
        return None
    bare = _marks.sub("", word).strip().rstrip(".,").strip()
    low = latin(bare).replace("’", "'")
    if low in OTHER_PRAENOMINA:
        return OTHER_PRAENOMINA[low]
    for short in PRAENOMINA:
        if low == short.lower():
            return short
    key = spelling(bare)
    full = {spelling(v): k for k, v in PRAENOMINA.items()} | {spelling(k): v for k, v in OTHER_PRAENOMINA.items() if len(k) > 4}
    return full.get(key) if len(key) > 3 else None


def gender(nomen: str | None) -> str | None:
    """``f`` for a nomen in -a, ``m`` for one in -us or -i, else null."""
    if not nomen:
        return None
    return "f" if nomen.endswith("a") else "m" if nomen.endswith(("us", "i")) else None


def nomen_key(key: str) -> str:
    """The nomen without its case ending, so that both genders and the modern form in -y agree."""
    return re.sub(r"(us|a|um)$", "", key) if len(key) > 5 else key


# Endings of surnames, pet forms included; what precedes them is the stem.
COGNOMEN_ENDINGS = ("ilus", "ulus", "clus", "ila", "ula", "cla", "us", "or", "ion", "io", "ex", "ix", "ax", "a")


def cognomen_key(key: str) -> str:
    """The surname's stem: without its ending or that of its pet form."""
    for e in COGNOMEN_ENDINGS:
        if key.endswith(e) and len(key) - len(e) >= 4:
            return key[: -len(e)]
    return key


def _tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[\s ·]+", text) if t]


def _descent(tokens: list[str]) -> tuple[list[str], str | None]:
    """The tokens without ``X. f.`` and the father's forename."""
    out: list[str] = []
    father = None
    i = 0
    while i < len(tokens):
        nxt = latin(tokens[i + 1]).rstrip(".") if i + 1 < len(tokens) else ""
        if praenomen(tokens[i]) and nxt in DESCENT and (nxt != "l" or tokens[i + 1] == "l."):
            if nxt in ("f", "filius", "filia", "υιος", "υ"):
                father = praenomen(tokens[i])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out, father


@functools.lru_cache(maxsize=200_000)
def parse(text: str | None) -> Name:
    """The parts of a written name.

    Known forms: ``Praenomen Nomen X. f. Cognomen``, any part missing; ``Cognomen, Praenomen Nomen``; ``Nomen Cognomen, Praenomen``;
    catalogue numbers before, ``(= other spelling)``, ``(2)``, ``?`` and ``[restored]`` letters anywhere; capitals; Greek.  Null, blank and letterless
    names have no part.
    """
    if not text or not re.search(r"[^\W\d_]", re.sub(r"\[[^\]]*\]", "", text)):
        return Name(None, None, False, None, None, None)
    text = _marks.sub("", _bracket.sub(" ", _code.sub("", text.strip())))
    parts = [p for p in (_tokens(x) for x in text.split(",")) if p]
    father, found = None, None
    sides: list[list[str]] = []
    for p in parts:
        rest, f = _descent(p)
        father = father or f
        if rest and (code := praenomen(rest[0])) and (len(rest) > 1 or len(parts) > 1):
            found = found or code
            rest = rest[1:]
        elif len(rest) > 1 and (code := praenomen(rest[-1])) and len(rest) > 2:
            found = found or code
            rest = rest[:-1]
        if rest:
            sides.append(rest)
    if not sides:
        return Name(found, None, False, None, None, father)
    words = sides[0] if len(sides) == 1 else [*sides[1], *sides[0]]
    words = [w for w in words if spelling(w)]
    if not words:
        return Name(found, None, False, None, None, father)
    raw = words[0]
    cut = raw.endswith(".") and len(words) > 1 and len(spelling(raw)) >= 2
    nomen = spelling(raw, not cut)
    cognomen = spelling(words[1]) if len(words) > 1 else None
    return Name(found, nomen, cut, cognomen or None, None if cut else gender(nomen), father)


def letters(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("ascii", "replace"), np.uint8)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """The Levenshtein distance of each pair (a true metric), all pairs side by side: one vector step for each cell of the table."""
    n = len(left)
    if not n:
        return np.zeros(0, np.int16)
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    wa, wb = int(la.max()), int(lb.max())
    a = np.zeros((max(wa, 1), n), np.uint8)
    b = np.ones((max(wb, 1), n), np.uint8)
    for i, (x, y) in enumerate(zip(left, right)):
        a[: len(x), i] = letters(x)
        b[: len(y), i] = letters(y)
    row = np.repeat(np.arange(wb + 1, dtype=np.int16)[:, None], n, 1)
    out = np.where(la == 0, lb, 0).astype(np.int16)
    for i in range(wa):
        last, row[0] = row[0].copy(), i + 1
        for j in range(1, wb + 1):
            best = np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + (a[i] != b[j - 1]))
            last = row[j].copy()
            row[j] = best
        done = la == i + 1
        if done.any():
            out[done] = row[lb[done], np.flatnonzero(done)]
    return out
