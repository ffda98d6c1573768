"""Words of free text, as the operators on training data compare them."""

from __future__ import annotations

import re
import unicodedata

import regex

_LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
#: A hyphen at a line end, between letters or digits; the soft hyphen counts there too.
_BROKEN = re.compile(rf"(?<=[^\W_])[-\u2010\u2011\u00ad][ \t\u00a0]*{_LINE_END}\s*(?=[^\W_])")
_DROPPED = regex.compile(r"[[\p{Cf}\p{Mn}\p{Me}]--[\u00ad]]+", regex.V1)
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case, accents, invisible characters and typographic letter forms.

    A word broken by a hyphen at a line end is one word. None and texts without letters and digits have no words.
    """
    if not text:
        return []
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKD", text)).casefold()
        return _WORD.findall(_BROKEN.sub("", text).replace("\u00ad", ""))
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _ASCII_WORD.findall(text.lower())


def case_words(text: str | None) -> list[str]:
    """Runs of letters or digits, case ignored; nothing else is changed."""
    return _WORD.findall(text.casefold()) if text else []
