"""Sentence boundaries across languages and scripts: a finite transducer, run by parallel prefix scan."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.runtime import ship

# Classes of characters, the transducer's input alphabet.
IGNORE, SPACE, LOWER, UPPER, DIGIT, OPEN, CLOSE, STOP, HARD, JOIN, SYMBOL, SAID, BREAK = range(13)
CLASSES = 13
#: Brackets and quotations are followed to this depth; deeper ones count as this deep.
DEPTH = 8
#: What is pending: nothing, a stop, a stop and white space, a stop that needs no white space.
NONE, MARK, GAP, SURE = range(4)
STATES = DEPTH * 4

# Abbreviations (without the last stop, lower case) after which a sentence never ends.
TITLES = "dr mr mrs ms prof st ste rev hon gen capt lt sgt messrs dott sig sigg avv ing hr hrn mgr msgr dipl cf cfr vgl vs ca approx viz bzw resp incl env sog ggf evtl insb πρβλ βλ δρ κ δηλ".split()
# Abbreviations after which a sentence does not end if a number follows.
NUMBERED = "no nos vol vols pp fig figs pl pls ch sec sect art lib frag col cols ll vv nn ms mss inv nr bd abb taf kap anm αρ στ σελ τ fol ff cos coss pr tr leg procos aed cens jan feb mar apr jun jul aug sep sept oct okt nov dec dez".split()
# Forenames as abbreviated on inscriptions; a name follows.
FORENAMES = "Cn Sex Sext Ti Tib Ap App Sp Ser Serv Mn Mam".split()
# Abbreviations of several stops that never end a sentence; others of that form may.
DOTTED = {"e.g.", "i.e.", "z.b.", "d.h.", "u.a.", "s.v.", "q.v.", "o.ä.", "m.p.", "v.l.", "i.a."}
# The months in German, after which an ordinal number's stop ends nothing.
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sept?|Okt|Nov|Dez|Jh|Jhs|Jahrhunderts?|Jahrtausends?"
# Marks that end a sentence with or without white space after them.
HARD_MARKS = "。｡！？．।॥።។៕။᠃։"
# Marks that end a sentence before white space.
STOP_MARKS = ".!?…؟۔‼⁇⁈⁉‽"
# Marks after which a sentence goes on.
JOIN_MARKS = ",;:&=/–—-،؛、，；：·|+~_%"

_word = r"[^\W\d_]"
_stop = re.compile(rf"(?<![\w'’\-])(?<![\s(\[\x00.\-]\w\.)({_word}{{1,7}}['’]?)\.")
_christ = re.compile(r"(?<!\w)(?:av|apr|ap)(\.)(?=\s+J)")
_dotted = re.compile(rf"(?<![\w.])((?:{_word}{{1,3}}\.[-–]?){{2,}})")
_devanagari = re.compile(r"(?:डॉ|श्री|श्रीमती|सुश्री|पं|प्रो|कु)(\.)")
_ordinal = re.compile(rf"(?<!\w)\d{{1,3}}(\.)(?=\s+(?:{MONTHS})\b)|(?<!\w)(?:[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Bb]eim)\s+\d{{1,3}}(\.)(?=\s)")
_date = re.compile(r"(?<![\d.])\d{1,2}(\.)\s+\d{1,2}(\.)(?=\s+\d{2,4}\b)")
_url = re.compile(r"(?:https?://|www\.)[^\s\x00]+", re.I)
_tight = re.compile(rf"(?:{_word}{{2}}|[\d)\]\"'”’»“])([.!?…]+)(?=[\"'”’»“)\]]*[(\[„«“‘\"]?[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫА-Я](?:{_word}|\.\s))")
_paragraph = re.compile(r"(?:\r\n?|\n| |\x85)[ \t ﻿​]*(?:\r\n?|\n| |\x85)\s*| \s*|\x0c\s*")
_list = re.compile(r"(?:(?<=[\n\r\x00])|\A)([ \t]*)((?:[•‣◦▪●○∙*–—-]|\(?(\d{1,3})[.)]|\([a-zA-Z]{1,4}\)|[a-zA-Z]\))[ \t]+)(?=[^\s\x00])")
_thai_space = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=[^\s\x00])\s+(?=[฀-๿])")
_dots = re.compile(r"(?<=[぀-ヿ㐀-鿿])…+(?=[^\s\x00”」』’）])")
_greek_question = re.compile("[;;]")
_said_ja = re.compile(r"[。！？…!?][」』”’）]+(?=と|って|という|との|の|は|が|を|に|も|で|か|，|,|、)")
_said_zh = re.compile(r"[！？!?…][”』’]+(?=然后|接着|随后|于是|之后|便|就|并|而|但|又|也|的|地)|[。！？!?…][”』’]+(?=(?:[他她它我你]们?|[一-鿿]{1,3}者)(?:说|问|道|答|喊|叫)|(?:说|问|道|答|喊|叫)[道着了：，。])")
_double = re.compile(r'"([^"\x00]*?)"')
_low = re.compile("([„‚])([^“”‘’„‚\x00]*)([“”‘’])")
_pairs = (
    (re.compile(r"(?<![\w'.])'(?=\w)"), re.compile(r"(?<=[\w.!?,;:…])(?<!\bM)'(?!\w)")),
    (re.compile(r"(?<!\w)‘(?=\w)"), re.compile(r"’(?!\w)")),
)
_forenames = frozenset(FORENAMES)
_titles = frozenset(TITLES)
_numbered = frozenset(NUMBERED)
_number_follows = re.compile(r"\s*(?:[\d°\[]|[IVXLCDM]+\b|[ivxlcdm]+\b)")


@functools.cache
def _base_classes() -> np.ndarray:
    """The class of every code point by its Unicode category and the tables above."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    by = {"Lu": UPPER, "Lt": UPPER, "Lo": UPPER, "Ll": LOWER, "Lm": LOWER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Ps": OPEN, "Pi": OPEN, "Pe": CLOSE, "Pf": CLOSE, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Mn": IGNORE, "Mc": IGNORE, "Me": IGNORE, "Cf": IGNORE, "Cn": IGNORE, "Cs": IGNORE, "Co": IGNORE, "Cc": IGNORE}
    for i in range(min(0x110000, sys.maxunicode + 1)):
        c = by.get(unicodedata.category(chr(i)))
        if c is not None:
            out[i] = c
    for c in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f":
        out[ord(c)] = SPACE
    for marks, c in ((HARD_MARKS, HARD), (STOP_MARKS, STOP), (JOIN_MARKS, JOIN), ("\"'’‘", IGNORE)):
        for x in marks:
            out[ord(x)] = c
    return out


@functools.cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, cut before this character)`` by state and class, flattened; the rules compiled."""
    step = np.zeros((STATES, CLASSES), np.uint8)
    cut = np.zeros((STATES, CLASSES), bool)
    for depth in range(DEPTH):
        for pending in range(4):
            for c in range(CLASSES):
                d, p, x = depth, pending, False
                ready = depth == 0 and pending in (GAP, SURE)
                if c == SPACE:
                    p = GAP if pending == MARK else pending
                elif c == LOWER:
                    x, p = depth == 0 and pending == SURE, NONE
                elif c in (UPPER, DIGIT, SYMBOL):
                    x, p = ready, NONE
                elif c == OPEN:
                    x, p, d = ready, NONE, min(depth + 1, DEPTH - 1)
                elif c == CLOSE:
                    d, p = max(depth - 1, 0), MARK if pending == GAP else pending
                elif c == SAID:
                    d, p = max(depth - 1, 0), NONE
                elif c == STOP:
                    p = SURE if pending == SURE else MARK
                elif c == HARD:
                    p = SURE
                elif c == JOIN:
                    p = NONE
                elif c == BREAK:
                    x, d, p = True, 0, NONE
                step[depth * 4 + pending, c], cut[depth * 4 + pending, c] = d * 4 + p, x
    return step.reshape(-1), cut.reshape(-1)


def _label(text: str, codes: np.ndarray) -> np.ndarray:
    """The class of each character of ``text`` (documents, each followed by NUL): by code point, then by context."""
    k = _base_classes()[codes]
    for m in _stop.finditer(text):
        word, at = m[1], m.end() - 1
        low = word.lower()
        after = text[at + 1 : at + 2]
        if len(word.rstrip("'’")) == 1:
            if word[0].isupper() or word[0].islower():
                k[at] = IGNORE if not after.isdigit() else k[at]
        elif low in _titles or (word in _forenames and after.isspace()):
            k[at] = JOIN
        elif low in _numbered and _number_follows.match(text, at + 1):
            k[at] = JOIN
    for m in _dotted.finditer(text):
        if m[1].lower() in DOTTED or text[m.end() : m.end() + 2].strip()[:1].isdigit():
            k[m.start() : m.end()][codes[m.start() : m.end()] == 46] = IGNORE
    for m in _devanagari.finditer(text):
        k[m.start(1)] = JOIN
    for pattern in (_ordinal, _date, _christ):
        for m in pattern.finditer(text):
            for g in range(1, pattern.groups + 1):
                if m.start(g) >= 0:
                    k[m.start(g)] = JOIN
    for m in _greek_question.finditer(text):
        for i in range(m.start() - 1, max(m.start() - 60, -1), -1):
            if text[i].isalpha():
                if "Ͱ" <= text[i] <= "Ͽ" or "ἀ" <= text[i] <= "῿":
                    k[m.start()] = STOP
                break
            if text[i] == "\x00":
                break
    for m in _tight.finditer(text):
        if (k[m.start(1) : m.end(1)] == STOP).all():
            k[m.start(1) : m.end(1)] = HARD
    for m in _dots.finditer(text):
        k[m.start() : m.end()] = JOIN
    for m in _url.finditer(text):
        end = len(m[0].rstrip(".,;:!?)»”\"'")) + m.start()
        k[m.start() : end] = LOWER
    breaks = [m.start() for m in _paragraph.finditer(text)]
    _quotes(text, k, breaks)
    for m in _said_ja.finditer(text):
        k[m.end() - 1] = SAID
    for m in _said_zh.finditer(text):
        k[m.end() - 1] = SAID
    k[breaks] = BREAK
    _lists(text, k)
    for m in _thai_space.finditer(text):
        k[m.start()] = BREAK
    return k


def _quotes(text: str, k: np.ndarray, breaks: list[int]) -> None:
    """Pairs of quotation marks inside one paragraph open and close; marks without a partner are ignored."""
    stops = np.array(breaks, dtype=np.int64)

    def pair(a: int, b: int) -> None:
        if np.searchsorted(stops, a) == np.searchsorted(stops, b):
            k[a], k[b] = OPEN, CLOSE

    for m in re.finditer("[«»]", text):  # »…« as well as «…»
        i = m.start()
        before, after = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
        if m[0] == "»" and (before.isspace() or before in "(\x00") and after.isalnum():
            k[i] = OPEN
        elif m[0] == "«" and not (before.isspace() or before in "(\x00") and not after.isalnum():
            k[i] = CLOSE
    at = 0
    for end in [*breaks, len(text)]:  # straight quotes pair within a paragraph
        if '"' in text[at:end]:
            for m in _double.finditer(text, at, end):
                k[m.start()], k[m.end() - 1] = OPEN, CLOSE
        at = end
    for m in _low.finditer(text):
        pair(m.start(1), m.start(3))
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 0)
    for opening, closing in _pairs:  # an open mark goes with the first closing one of its paragraph; one pass over both lists
        shut = [m.start() for m in closing.finditer(text)]
        open_ = [m.start() for m in opening.finditer(text)]
        if not open_ or not shut:
            continue
        place = lambda xs: (np.searchsorted(stops, xs), np.searchsorted(ends, xs))
        (op, od), (sp, sd) = place(open_), place(shut)
        at, j = 0, 0
        for i, o in enumerate(open_):
            if o < at:
                continue
            while j < len(shut) and shut[j] < o + 2:
                j += 1
            if j == len(shut):
                break
            if op[i] == sp[j] and od[i] == sd[j]:
                k[o], k[shut[j]] = OPEN, CLOSE
                at = shut[j] + 1


def _lists(text: str, k: np.ndarray) -> None:
    """A line that starts with a list mark is an item: the line break before it ends what went before; the mark ends nothing.

    A number is a list mark only as 1 at the start of a paragraph or before a line with 2, or as one more than the last one.
    """
    marks = list(_list.finditer(text))
    if not marks:
        return
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = [m.start() for m in marks]
    owner = np.searchsorted(np.flatnonzero(codes == 0), lines)  # the document of each mark
    breaks = np.searchsorted(np.flatnonzero(codes == 10), lines)  # line feeds before it
    ahead: list[int | None] = [None] * len(marks)  # the number of the next numbered mark of the same document
    after: tuple[int, int] | None = None
    for i in range(len(marks) - 1, -1, -1):
        ahead[i] = after[1] if after is not None and after[0] == owner[i] else None
        if marks[i][3]:
            after = (owner[i], int(marks[i][3]))
    last: tuple[int, int] | None = None  # the last list number: its mark and value
    for i, m in enumerate(marks):
        line = m.start()
        if m[3]:
            n = int(m[3])
            fresh = line == 0 or text[line - 1] == "\x00" or k[line - 1] == BREAK or text[max(0, line - 2) : line].strip(" \t") in ("\n\n", "")
            follows = last is not None and last[1] + 1 == n and owner[last[0]] == owner[i] and breaks[i] - breaks[last[0]] <= 2
            if not (follows or (n == 1 and (fresh or ahead[i] == 2))) or not text[m.end() : m.end() + 1].isalpha():
                continue
            last = (i, n)
        k[m.start(2) : m.end(2)] = np.where(k[m.start(2) : m.end(2)] == SPACE, SPACE, IGNORE)
        if line and text[line - 1] != "\x00":
            k[line - 1] = BREAK


def scan(labels: np.ndarray) -> np.ndarray:
    """Where the transducer cuts, as if run over ``labels`` from the start; chunks are run side by side.

    Each chunk is first run from every state, which makes it a function from states to states; the functions are composed by a
    parallel prefix scan (doubling), so each chunk's true start state is known, and a second run from there gives the cuts.  A text
    of any length is thus cut in a number of vector steps that grows with the square root of its length.
    """
    n = len(labels)
    if not n:
        return np.zeros(0, bool)
    step, cut = transducer()
    lanes = int(min(4096, max(1, n // 64)))
    length = -(-n // lanes)
    grid = np.full(lanes * length, IGNORE, np.uint8)
    grid[:n] = labels
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
    run = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], lanes, 1)
    for row in grid:
        run = step.take(run * CLASSES + row).astype(np.intp)
    k = 1
    while k < lanes:  # run[:, j] becomes the composition of the chunks 0..j
        run[:, k:] = np.take_along_axis(run[:, k:], run[:, :-k].copy(), 0)
        k *= 2
    state = np.zeros(lanes, np.intp)
    state[1:] = run[0, :-1]
    out = np.zeros((length, lanes), bool)
    for i, row in enumerate(grid):
        at = state * CLASSES + row
        out[i] = cut.take(at)
        state = step.take(at).astype(np.intp)
    return out.T.reshape(-1)[:n]


def sentence_ends(texts: list[str | None]) -> list[list[int]]:
    """For each text the ends of its sentences, as numbers of code points from its start; none for null, empty and blank texts."""
    joined = "".join(f"{(t or '').replace(chr(0), ' ')}\x00" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    labels = _label(joined, codes)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    ends = np.cumsum(sizes) - 1
    labels[ends] = BREAK
    begins = ends - sizes + 1
    cuts = np.flatnonzero(scan(labels))
    base = _base_classes()[codes]
    solid = (base != SPACE) & ~np.isin(codes, [0, 0x200B, 0xFEFF, 0xAD, 0x200E, 0x200F])
    last = np.maximum.accumulate(np.where(solid, np.arange(len(codes)), -1))
    at = np.where(cuts > 0, last[np.maximum(cuts - 1, 0)], -1)
    doc = np.searchsorted(ends, cuts)
    keep = at >= begins[doc]
    at, doc = at[keep], doc[keep]
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    at, doc = at[fresh], doc[fresh]
    local = at + 1 - begins[doc]
    out: list[list[int]] = [[] for _ in texts]
    for i, e in zip(doc.tolist(), local.tolist()):
        out[i].append(e)
    return out


def sentences(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, end_pos)``: one row for each sentence of each document.

    ``end_pos`` counts the code points up to and including the sentence's last character, closing quotes and brackets included,
    white space after it not.  Null, empty and blank texts have no sentence; texts of any length are processed whole; a text without
    any mark is one sentence; repeated ids give the ends of each of their texts, once each; an empty table gives an empty result.
    Other columns are ignored.  There is no shuffle but the one that drops rows repeated within ``documents``.
    """
    ship(documents.sparkSession)
    kind = documents.schema[ident].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # about a million characters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1_000_000):
                    size += len(texts[to] or "")
                    to += 1
                found = sentence_ends(texts[at:to])
                rows = np.repeat(np.arange(at, to), [len(x) for x in found])
                flat = np.array([e for x in found for e in x], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(flat)], names=[ident, "end_pos"])
                at = to

    return documents.select(ident, text).where(f"`{ident}` is not null").mapInArrow(cut, f"`{ident}` {kind}, end_pos long").distinct()
