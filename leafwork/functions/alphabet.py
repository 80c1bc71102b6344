"""Characters of right-to-left text and what they stand for."""

from __future__ import annotations

import unicodedata

ARABIC = "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff"
MARKS = "\u064b-\u0652\u0670\u0640"
FORMS = {chr(c): d for lo, hi in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF)) for c in range(lo, hi + 1) if (d := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
FRONT, BACK = "([{<«)]}>»", ")]}>»([{<«"
EASTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
INVISIBLE = "\u2069\u2068\u2067\u2066\u202c\u202b\u202a\u200f\u200e\u200d\u200c\u200b"
#: Frequent words that show which way round a string is.
FREQUENT = (
    "أن", "أو", "إجابات", "إجابة", "إلى", "إن", "التلاميذ", "التي", "الدرس", "الذي", "السؤال", "الصف", "القراءة", "النص",
    "الهدف", "بعد", "بين", "ثم", "حتى", "حيث", "ذلك", "على", "عن", "عند", "في", "قبل", "قد", "كان",
    "كل", "كما", "لدى", "لكن", "مع", "من", "منذ", "نحو", "هذا", "هذه", "هم", "هو", "هي", "والتي",
    "وفي", "ومن",
)
TOKEN = r"(?s)[0-9A-Za-z][-/:,.0-9A-Za-z]*|."
