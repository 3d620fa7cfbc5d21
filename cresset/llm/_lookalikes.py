"""Characters that look like others, and the form of a text without them."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts and the Latin letters they look like.
_CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеѕіјорсухԁԛԝһү", "ABESIJKMHOPCTYXYGQWhaesijopcyxdqwhy")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳανορυϲ", "ABEZHIKMNOPTYXCjavopuc")
_ARMENIAN = ("ՍՏՕօսոցհզագռք", "USOounghqwqnf")
_CHEROKEE = ("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎠᎡᎥᎩᎽᏂᏏᏔᏕᏧᏻ", "ABCEGHJKLMPRSTVWZDRiYYhbWSdG")
# Letters that pass for Latin ones, but for which Latin ones aren't used.
_CYRILLIC_TOO = ("ЬгѡѴѵҽӀӏ", "brwVveli")
_GREEK_TOO = ("ͿγισϒϜϱϺ", "JyioYFpM")
_COPTIC = ("ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⳐ", "rHlKMNOoPpCcTYXL")

#: Look-alike letter to Latin letter.
TO_LATIN = {a: b for pair in (_CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE, _CYRILLIC_TOO, _GREEK_TOO, _COPTIC) for a, b in zip(*pair, strict=True)}
_TO_LATIN = str.maketrans(TO_LATIN)
#: Latin letter to look-alike letter, for words of these scripts that hold Latin letters.
TO_CYRILLIC, TO_GREEK = (str.maketrans({b: a for a, b in zip(*pair, strict=True)}) for pair in (_CYRILLIC, _GREEK))

# Ranges of code points, as within brackets of a pattern.
FULL_WIDTH = "\uff01-\uff60\uffe0-\uffe6"
LIGATURES = "\ufb00-\ufb06\ufb13-\ufb17"
MARKS = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f\u3099\u309a"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e01ef"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACES = re.compile(f"[{SPACES}]")
_COMPATIBLE = re.compile(f"[{FULL_WIDTH}{LIGATURES}]")


def plain_form(text: str) -> str:
    """The text with ordinary widths, spaces and letters instead of ligatures, without invisible signs, accents precomposed."""
    text = _SPACES.sub(" ", _INVISIBLE.sub("", text))
    return unicodedata.normalize("NFC", _COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text))


def in_latin(word: str) -> str:
    """The word with look-alike letters of other scripts as Latin letters."""
    return word.translate(_TO_LATIN)
