"""Character classes and patterns.

Classes are spelled out with Unicode properties, so that they mean the same on every
regex engine and do not depend on whether ``\\w``, ``\\s`` or ``\\b`` are Unicode-aware.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from mailsift import config

WS = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"  # body of a class: white space
WORD = r"\p{L}\p{N}_"  # body of a class: word characters
SPACE = f"[{WS}]"
NONSPACE = f"[^{WS}]"
PUNCT = r"[!-/:-@\[-`{-~]"  # the 32 ASCII punctuation characters
DIGITS = r"\p{Nd}"
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"  # Unicode word boundary

_TLD = "|".join(config.LINK_TLDS)
_LINK_HEAD = rf"(?:http|https)://[^{WS}/$.?#][^\n]{NONSPACE}*|www\.[^{WS}/$.?#][^\n]{NONSPACE}*"
# A bare name can only start where a run of host characters starts, which keeps the scan linear.
URL = rf"{_LINK_HEAD}|(?<![a-zA-Z0-9.-])[a-zA-Z0-9.-]+\.(?:{_TLD})(?![{WORD}])"
HAS_URL = rf"://|www\.|\.(?:{_TLD})"  # necessary for a match of URL
DOMAIN = r"^(?:https?://)?(?:www\.)?([^/?]*)"
IP = rf"(^|[^{WORD}]){DIGITS}{{1,3}}(\.{DIGITS}{{1,3}}){{3}}($|[^{WORD}])"
CYRILLIC = r"[\x{0400}-\x{04FF}]"

# Text cleaning. An address fills its whole run of non-space characters, so one anchored,
# possessive attempt per run is enough.
CLEAN_FILLER = rf"[{WS}{DIGITS}!-/:-@\[-`{{-~]+"  # digits, punctuation and space in one pass
CLEAN_URL = rf"https?://{NONSPACE}+|www\.{NONSPACE}+"
CLEAN_EMAIL = rf"(?<!{NONSPACE}){NONSPACE}[^@{WS}]*+@{NONSPACE}+\.{NONSPACE}+"

# Personal data
PII_EMAIL = rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}"
PII_PHONE = (rf"(?=[+({DIGITS}]){EDGE}(?:\+?{DIGITS}{{1,3}}[-.{WS}]?)?\(?{DIGITS}{{2,4}}\)?[-.{WS}]?"
             rf"{DIGITS}{{3,4}}[-.{WS}]?{DIGITS}{{3,4}}{EDGE}")
PII_NAME = rf"(?=[A-Z])(?<![{WORD}])[A-Z][a-z]+(?:{SPACE}[A-Z][a-z]+)+(?![{WORD}])"

NON_ASCII = r"[^\x00-\x7f]"
ASCII_RUN = r"[\x00-\x7f]+"
ASCII_LETTERS = "[A-Za-z]+"
ASCII_UPPER = "[A-Z]+"
ASCII_SYMBOLS = r"[!-/:-@\[-^`{-\x7f\x00-\x08\x0e-\x1b]+"
INVISIBLE = r"[\x{200B}-\x{200D}\x{FEFF}\x{00AD}\x{2060}]"
REPEATED = r"([^\n])\1{10,}"
SYMBOL = f"[^{WORD}{WS}]"
# Upper case includes Roman numerals and circled or squared capitals, which are not in Lu.
UPPER = (r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}"
         r"\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]")
HEADER_DOMAIN = rf"@([{WORD}.-]+)"


def _ranges(points: list[int]) -> str:
    """Body of a regex class covering sorted code points."""
    out, start, last = [], None, None
    for p in [*points, None]:
        if start is not None and p == last + 1:
            last = p
            continue
        if start is not None:
            out.append(rf"\x{{{start:X}}}" + (rf"-\x{{{last:X}}}" if last > start else ""))
        start = last = p
    return "".join(out)


@functools.lru_cache(maxsize=None)
def _by_first_word(limit: int) -> dict[str, list[int]]:
    """Code points grouped by the first word of their Unicode name."""
    groups: dict[str, list[int]] = {}
    for cp in range(limit):
        name = unicodedata.name(chr(cp), "")
        if name:
            groups.setdefault(name.split()[0], []).append(cp)
    return groups


@functools.lru_cache(maxsize=None)
def script_letters(script: str) -> str:
    """Class of the letters whose Unicode name starts with ``script``, such as LATIN."""
    points = _by_first_word(sys.maxunicode + 1)[script]
    return f"[{_ranges([p for p in points if chr(p).isalpha()])}]"


@functools.lru_cache(maxsize=None)
def single_script(ascii_only: bool) -> str:
    """Matches a string whose characters all share the first word of their Unicode name.

    Dots, hyphens and nameless characters are to be removed first.
    """
    groups = _by_first_word(128 if ascii_only else sys.maxunicode + 1)
    words = sorted(groups, key=lambda w: -len(groups[w]))
    return "^(?:" + "|".join(f"[{_ranges(groups[w])}]*+" for w in words) + ")$"
