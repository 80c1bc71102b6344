"""Unicode repair of one right-to-left text, as ``script`` has it for columns."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from leafwork.functions.alphabet import ARABIC, BACK, EASTERN, FORMS, FREQUENT, FRONT, INVISIBLE, MARKS

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_FORM = re.compile("[\ufb50-\ufdff\ufe70-\ufeff]")
_BASE = {ord(a): b for a, b in FORMS.items()}
_INVISIBLE, _MARK, _DIGIT, _BLANK = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{MARKS}]"), re.compile(f"[{EASTERN}]"), re.compile("[ \t\xa0]+")
_HEAD, _TAIL = re.compile(f"[{SPACE}]+"), re.compile(f"[{SPACE}]+\\Z")
_WORD = re.compile("[\u0600-\u06ff\u0750-\u077f]+")
_RUN = re.compile("([0-9A-Za-z][-/:,.0-9A-Za-z]*)")
_BRACKET, _OTHER = re.compile(f"[{re.escape(FRONT)}]"), dict(zip(FRONT, BACK))
_WEST = {ord(c): str(i % 10) for i, c in enumerate(EASTERN)}
_LEAD = re.compile("(?s)([?\u061f!:\u061b\u060c.]+)[ \t-\r]*(.+)")
_NUMBER = re.compile("(?s)\\.[ \t-\r]*(.*?)([0-9\u0660-\u0669]{1,2})\\.?")
_FREQUENT = frozenset(FREQUENT)
_kinds: list[np.ndarray] = []


def strip(t: str) -> str:
    """White space off both ends, by Unicode's notion of it."""
    head = _HEAD.match(t)
    t = t[head.end() :] if head else t
    if t and _HEAD.match(t[-1]):
        t = t[: _TAIL.search(t).start()]
    return t


def deshape(t: str) -> str:
    return t.translate(_BASE) if _FORM.search(t) else t


def is_arabic(t: str, least: float = 0.25) -> bool:
    """Whether at least ``least`` of the letters are Arabic; false without letters."""
    if not _kinds:
        letter = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])
        own = re.compile(f"[{ARABIC}]")
        _kinds.extend([letter, letter & np.array([i < 0x10000 and own.match(chr(i)) is not None for i in range(0x110000)])])
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    letters = np.count_nonzero(_kinds[0][codes])
    return bool(letters and np.count_nonzero(_kinds[1][codes]) / letters >= least)


def orientation(t: str) -> int:
    """Evidence that a string is in logical order: frequent words count 3, articles at the start 1 and at the end -1."""
    words = _WORD.findall(t)
    if _MARK.search(t):
        words = [_MARK.sub("", w) for w in words]
    score = 0
    for w in words:
        if w in _FREQUENT:
            score += 3
        if len(w) > 3:
            score += w.startswith("\u0627\u0644") - w.endswith("\u0644\u0627")
    return score


def reverse_runs(t: str) -> str:
    """The string backwards, with Latin and digit runs as they were and brackets mirrored."""
    parts = _RUN.split(t)
    parts[::2] = [p[::-1] for p in parts[::2]]
    return _BRACKET.sub(lambda m: _OTHER[m[0]], "".join(reversed(parts)))


def repair_punctuation(t: str) -> str:
    """Punctuation that a reversal left at the head goes to the end; so does a list number that it left there."""
    t = strip(t)
    m = _LEAD.fullmatch(t)
    if m and is_arabic(m[2]):
        t = strip(m[2]) + m[1]
    m = _NUMBER.fullmatch(t)
    return f"{m[2]}. {strip(m[1])}." if m and is_arabic(m[1]) else t


def normalize(t: str, strip_tatweel: bool = True, strip_marks: bool = False, western_digits: bool = False, collapse: bool = True) -> tuple[str, bool, bool]:
    """The text repaired, whether it had presentation forms, whether it was backwards."""
    t = _INVISIBLE.sub("", t)
    probe = deshape(t)
    backwards = is_arabic(probe) and orientation(reverse_runs(probe)) > orientation(probe)
    out = repair_punctuation(deshape(reverse_runs(t) if backwards else t))
    if strip_tatweel:
        out = out.replace("\u0640", "")
    if strip_marks:
        out = _MARK.sub("", out)
    if western_digits and _DIGIT.search(out):
        out = out.translate(_WEST)
    return strip(_BLANK.sub(" ", out)) if collapse else out, _FORM.search(t) is not None, backwards
