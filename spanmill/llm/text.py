"""Text normalisation shared by the text operators."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*>")
_INLINE = {"b", "i", "em", "strong", "u", "s", "span", "a", "sup", "sub", "font", "mark", "small"}
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n`]*$", re.M)
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t>|]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Invisible: format characters and variation selectors.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")


def plain(text: str) -> str:
    """Without markup and invisible characters, compatibility forms folded, lower case."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(lambda m: "" if m.group(1).lower() in _INLINE else " ", t)
    if "```" in t or "~~~" in t:
        t = _FENCE.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", t))
    return t.casefold()


def words(text: str) -> list[str]:
    """Words of `plain` text: runs of letters and digits.

    Hyphens join, so that a word broken at a line's end is the word it was.
    """
    t = plain(text)
    if "-" in t:
        t = _BROKEN.sub("", t).replace("-", "")
    return _WORD.findall(t)
