"""What the three parsers share.

A source becomes a string with one character for each token, its kind: punctuation stands for
itself, longer operators and keywords for a private code point, and names, numbers and strings for
``n``, ``0`` and ``s``. The parsers descend over that string. Since the verdict on a piece of a
statement depends on its kinds alone, pieces without blocks that parsed once are remembered by
their kinds; every later piece of the same shape, in any file, is then one lookup.
"""

from __future__ import annotations

import sys

END = "\0"
BAD = "\uffff"

#: Frames that a descent may hold, some ten thousand levels of brackets.
FRAMES = 100_000


def allow(tokens: int) -> None:
    """Lets a descent over so many tokens nest as deeply as they can; frames of Python functions are no
    load on the machine's stack. Beyond FRAMES a source counts as nested too deeply."""
    need = min(16 * tokens + 2000, FRAMES)
    if sys.getrecursionlimit() < need:
        sys.setrecursionlimit(need)


class SyntaxFault(Exception):
    """A token that cannot stand where it stands."""

    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


class Shapes(set):
    """Kinds of pieces that have parsed."""

    def learn(self, shape: str) -> None:
        if len(shape) <= 160:
            if len(self) > 200_000:
                self.clear()
            self.add(shape)


class Kinds(dict):
    """Kind of a token by its text; ``classify`` says it of texts not seen before, None as second
    value of its answer where the text is not worth remembering."""

    def __init__(self, fixed: dict[str, str], classify) -> None:
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, text: str) -> str:
        kind, keep = self.classify(text)
        if keep:
            if len(self) > 300_000:
                self.clear()
                self.update(self.fixed)
            self[text] = kind
        return kind


def private(texts: list[str], start: int) -> dict[str, str]:
    """A private code point for each text."""
    return {text: chr(start + i) for i, text in enumerate(texts)}


class Descent:
    """Cursor over kinds, with panic-mode recovery for languages of blocks and semicolons."""

    def __init__(self, kinds: str) -> None:
        self.k = kinds + END
        self.i = 0
        self.errors: list[tuple[int, str]] = []

    def fail(self, message: str, at: int | None = None) -> None:
        raise SyntaxFault(self.i if at is None else at, message)

    def need(self, kind: str, what: str | None = None) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {what or kind}")
        self.i += 1

    def panic(self, fault: SyntaxFault, start: int) -> None:
        """Notes the fault and goes on behind the next semicolon, or before the brace that closes the
        block the statement stands in."""
        self.errors.append((fault.at, fault.message))
        k, i, depth = self.k, max(self.i, start), 0
        while True:
            c = k[i]
            if c == END:
                break
            if c == "{":
                depth += 1
            elif c == "}":
                if depth == 0:
                    break
                depth -= 1
                if depth == 0:
                    i += 1
                    break
            elif c == ";" and depth == 0:
                i += 1
                break
            i += 1
        self.i = i if i > start or k[i] in (END, "}") else i + 1
