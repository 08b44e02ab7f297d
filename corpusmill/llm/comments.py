"""The opening comment of a source file."""

from __future__ import annotations

import re

_FIRST = re.compile(r"﻿?(?:#![^\n]*(?:\n|\Z))?(?:[ \t\f]*#[^\n]*coding[:=][^\n]*(?:\n|\Z))?\s*")
_BLOCK = re.compile(r"/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|[rRuU]?\"\"\".*?(?:\"\"\"|\Z)|[rRuU]?'''.*?(?:'''|\Z)", re.DOTALL)
_LINES = re.compile(r"(?://[^\n]*(?:\n[ \t]*|\Z))+|(?:#[^\n]*(?:\n[ \t]*|\Z))+|(?:--[^\n]*(?:\n[ \t]*|\Z))+")
_MARKS = re.compile(r"^[ \t]*(?://+!?|#+|--|/\*+!?|\*+(?!/))?[ \t]*|[ \t]*(?:\*+/|-->|\"\"\"|''')[ \t]*$")


def opening(text: str) -> tuple[str, int]:
    """The first comment, behind a first line for the shell or the encoding, and where the rest begins.

    A comment is one block, one run of comment lines, or the string a module begins with. ('', start
    of the code) where there is none.
    """
    at = _FIRST.match(text).end()
    found = _BLOCK.match(text, at) or _LINES.match(text, at)
    return (found[0], found.end()) if found else ("", at)


def lines(comment: str) -> list[str]:
    """Its lines without comment marks."""
    if comment[:3] in ('"""', "'''"):
        comment = comment[3:]
    return [_MARKS.sub("", _MARKS.sub("", line)) for line in comment.splitlines()]


def readable(source: bytes | None) -> str:
    """Text of a source: UTF-8 with bad bytes replaced, and line ends as newlines."""
    text = bytes(source or b"").decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
