"""Folding of look-alike letters, invisible characters and compatibility forms."""

from __future__ import annotations

import unicodedata

import regex

#: Cyrillic, Greek and other letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "г": "r", "п": "n", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ʟ": "l", "ß": "ss", "ł": "l", "đ": "d", "ø": "o",
}
_TABLE = str.maketrans(LOOK_ALIKES)
_WORD = regex.compile(r"\w++")
_LATIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}ᅟᅠㅤ]")


def plain(text: str) -> str:
    """Compatibility forms, case, accents and invisible characters folded; whole words in another script kept."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text)
    t = _INVISIBLE.sub("", t)
    t = unicodedata.normalize("NFC", t).casefold()
    return _WORD.sub(_unmixed, t) if _OTHER.search(t) else t


def _unmixed(m: regex.Match) -> str:
    """A word that mixes scripts in Latin letters; a word in one script as it is."""
    w = m[0]
    return w.translate(_TABLE) if _OTHER.search(w) and _LATIN.search(w) else w


def latin(text: str) -> str:
    """As plain(), with every look-alike letter turned into its Latin twin."""
    t = plain(text)
    return t if t.isascii() else t.translate(_TABLE)
