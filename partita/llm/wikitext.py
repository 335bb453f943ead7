"""Wiki markup to the words a reader sees."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]*\s*([^\[\]]*)\]")
_EMPHASIS = re.compile(r"''+")
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")
_UNSEEN = re.compile(r"[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte encoding, where a stretch decodes cleanly."""

    def fix(m: re.Match[str]) -> str:
        s = m.group()
        try:
            return b"".join(c.encode("cp1252") if ord(c) > 255 else c.encode("latin-1") for c in s).decode("utf-8")
        except UnicodeError:
            return s

    for _ in range(3):  # some were broken more than once
        again = _MOJIBAKE.sub(fix, text)
        if again == text:
            break
        text = again
    return text


# Link prefixes that put a page somewhere and show nothing.
PLACING = ("category", "kategorie", "catégorie", "categoría")


def _shown(m: re.Match[str]) -> str:
    target, _, label = m.group(1).rpartition("|")
    if ":" in m.group(1) and m.group(1).split(":", 1)[0].strip().lower() in PLACING:
        return " "
    return label or target.split("|")[0]


def visible(text: str) -> str:
    """Links as the text they show; emphasis, tags, comments, footnotes and templates as nothing."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub(" ", text)
        text = _REF.sub(" ", text)
    while "{{" in text:
        text, n = _TEMPLATE.subn(" ", text)
        if not n:
            break
    while "[[" in text:
        text, n = _LINK.subn(_shown, text)
        if not n:
            break
    if "://" in text:
        text = _EXTERNAL.sub(r"\1", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _EMPHASIS.sub("", text) if "''" in text else text


def plain_words(text: str, markup: bool = True) -> list[str]:
    """Words as runs of letters and digits; case, accents, punctuation and blanks do not count."""
    ascii_ = text.isascii()
    if not ascii_:
        text = repair(text)
    if markup:
        text = visible(text)
    if not ascii_ or not text.isascii():
        text = _UNSEEN.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        if not text.isascii():
            text = "".join([c for c in text if not unicodedata.combining(c)])
    return _WORD.findall(text.casefold())
