"""Token sequences of source code: lexed vectors of every language, Java lexed by the engine's own
expressions, and the search for the single edit that mends a file."""

from __future__ import annotations

import heapq
import keyword
import math
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import languages
from corpusmill.operators.sequence import FIRST, SPECIAL, UNKNOWN

# Java by expressions. A source is one row, its tokens are one array; no token is shuffled.
# The classes of Java's literals and names, and how one of each is written out.
JAVA_CLASSES = {
    "IDENTIFIER": "ident", "UNDERSCORE": "_", "INTLITERAL": "0", "LONGLITERAL": "0L", "FLOATLITERAL": "0.0f", "DOUBLELITERAL": "0.0", "CHARLITERAL": "'c'", "STRINGLITERAL": '"string"',
}
JAVA_TEXT = JAVA_CLASSES | {word.upper(): word for word in languages._JAVA_WORDS} | {kind: mark for mark, kind in languages._JAVA_MARKS.items()}
JAVA_ENTRIES = sorted(JAVA_TEXT)
_MARKS = r">>>=|<<=|>>=|>>>|\.\.\.|->|::|==|<=|>=|!=|&&|\|\||\+\+|--|<<|>>|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[(){}\[\];,.=<>!~?:+*/&|^%@-]"
#: One pattern for both engines: comments, strings, characters, numbers, words, marks, all else. Runs are
#: written without alternatives inside, which the engine's matcher would nest.
JAVA_PATTERN = (
    r"(?s)/\*.*?\*/|//[^\n]*|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'(?:[^'\\\n]|\\[^\n]+?)'|0[xX][0-9a-fA-F_.]*(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|0[bB][01_]+[lL]?"
    r"|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?|[\p{L}_$][\p{L}\p{N}_$]*|" + _MARKS + r"|[^\s\x{FEFF}]"
)


def java_texts(source: Column) -> Column:
    """Token texts of a Java source without comments; null where it is no UTF-8. \\u escapes stay as they
    are written (``languages.java_tokens`` resolves them)."""
    text = F.try_validate_utf8(source.cast("string"))
    found = F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))
    return F.filter(found, lambda t: ~(t.startswith("/*") | t.startswith("//")))


def java_entry(token: Column) -> Column:
    """Kind of a token; null for what is none."""
    fixed = F.create_map(*(F.lit(x) for kind, text in JAVA_TEXT.items() if kind not in JAVA_CLASSES or kind == "UNDERSCORE" for x in (text, kind)))
    low = F.lower(token)
    hexadecimal = low.startswith("0x")
    number = (
        F.when(low.endswith("l"), "LONGLITERAL").when(low.endswith("f") & (~hexadecimal | F.contains(low, F.lit("p"))), "FLOATLITERAL")
        .when(F.contains(low, F.lit(".")) | F.contains(low, F.lit("p")) | (~hexadecimal & (F.contains(low, F.lit("e")) | low.endswith("d"))), "DOUBLELITERAL").otherwise("INTLITERAL")
    )
    return (
        F.when(token.rlike(r"^\.?[0-9]"), number)
        .when((F.length(token) > 1) & token.startswith('"'), "STRINGLITERAL").when((F.length(token) > 1) & token.startswith("'"), "CHARLITERAL")
        .otherwise(F.coalesce(fixed[token], F.when(token.rlike(r"^[\p{L}_$]"), "IDENTIFIER")))
    )


def java_vectors(sources: DataFrame, key: str = "hash") -> DataFrame:
    """``key`` and vector of Java sources: indices of the tokens' kinds, 0 for what is no token."""
    index = F.create_map(*(F.lit(x) for i, entry in enumerate(JAVA_ENTRIES) for x in (entry, i + FIRST)))
    vector = F.transform(java_texts(F.col("source")), lambda t: F.coalesce(index[java_entry(t)], F.lit(UNKNOWN)))
    return sources.select(key, vector.alias("vector")).where("vector IS NOT NULL")


def java_printed(vector: Column) -> Column:
    """A vector written out as Java, separated by spaces."""
    texts = F.array(*(F.lit(x) for x in [*SPECIAL, *(JAVA_TEXT[e] for e in JAVA_ENTRIES)]))
    return F.array_join(F.transform(vector, lambda i: F.get(texts, i)), " ")


# every language, by its lexer


def vocabulary(name: str) -> list[str]:
    """Entries of a language in the order of their indices, which begin behind the special ones."""
    if name == "python":
        classes = ["<IDENTIFIER>", "<NUMBER>", "<STRING>", *sorted(languages._LAYOUT)]
        return sorted({*keyword.kwlist, *tokenize.EXACT_TOKEN_TYPES, *classes})
    if name == "javascript":
        return languages.javascript_vocabulary()
    if name == "java":
        return JAVA_ENTRIES
    raise KeyError(f"{name}: one of java, javascript, python")


def lexed_vectors(sources: DataFrame, name: str) -> DataFrame:
    """hash, vector, lines: the index of each physical token of a source and its line. Null sources are
    empty; tokens outside the vocabulary have index 0."""
    languages.language(name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang = languages.language(name)
        index = {entry: i + FIRST for i, entry in enumerate(vocabulary(name))}
        for frame in frames:
            vectors, lines = [], []
            for source in frame["source"]:
                tokens = [t for t in lang.tokenise(bytes(source or b"")) if lang.physical(t)]
                vectors.append([index.get(lang.entry(t), UNKNOWN) if t.name not in ("ERROR", "ERRORTOKEN") else UNKNOWN for t in tokens])
                lines.append([t.line for t in tokens])
            yield pd.DataFrame({"hash": frame["hash"], "vector": vectors, "lines": lines})

    return sources.select("hash", "source").mapInPandas(run, "hash string, vector array<int>, lines array<int>")


# fixes

FIXES = "hash string, rank int, step int, code string, index int, token int, original int, line int"


def single_fixes(vector: list[int], scores: list[float], offered: list[list[int]], k: int = 3) -> Iterator[tuple[int, int, str, int, int | None, int | None]]:
    """(rank, step, code, index, token, original): the edits to try, in order. At each of the k worst
    positions, the earlier among equals first: insert each suggestion, remove the token, substitute it."""
    worst = heapq.nsmallest(k, range(len(vector)), key=lambda i: (-scores[i], i))
    for rank, i in enumerate(worst, 1):
        tries = [("i", t, None) for t in offered[i]] + [("x", None, vector[i])] + [("s", t, vector[i]) for t in offered[i] if t != vector[i]]
        for step, (code, token, original) in enumerate(tries):
            yield rank, step, code, i, token, original


def edited(vector: list[int], code: str, index: int, token: int | None) -> list[int]:
    """A vector with an edit."""
    return vector[:index] + ([] if code == "x" else [token]) + vector[index + (code != "i") :]


class Neighbours:
    """Distributions of a token by the one before and the one behind it, from counts of neighbours."""

    def __init__(self, counts: dict[tuple[int, int], int], size: int, alpha: float = 1.0) -> None:
        self.size, self.alpha, self.counts = size, alpha, counts
        self.after: dict[int, dict[int, int]] = {}
        self.before: dict[int, dict[int, int]] = {}
        for (a, b), n in counts.items():
            self.after.setdefault(a, {})[b] = n
            self.before.setdefault(b, {})[a] = n
        self._sum = {(d, t): sum(row.values()) for d, table in ((0, self.after), (1, self.before)) for t, row in table.items()}
        self._top: dict[tuple[int, int], list[int]] = {}

    def entropy(self, side: int, given: int, token: int) -> float:
        row = (self.after, self.before)[side].get(given, {})
        return -math.log((row.get(token, 0) + self.alpha) / (self._sum.get((side, given), 0) + self.alpha * self.size))

    def best(self, side: int, given: int, k: int = 3) -> list[int]:
        """The k most probable tokens, lower ones first among equals."""
        if (side, given) not in self._top:
            row = (self.after, self.before)[side].get(given, {})
            self._top[side, given] = heapq.nsmallest(k, range(FIRST, self.size), key=lambda t: (-row.get(t, 0), t))
        return self._top[side, given]

    def judged(self, vector: list[int], start: int = 1, end: int = 2) -> tuple[list[float], list[list[int]]]:
        """Cross-entropy of each token under both sides, and what either side would rather see there."""
        around = [start, *vector, end]
        scores = [self.entropy(0, around[i], t) + self.entropy(1, around[i + 2], t) for i, t in enumerate(vector)]
        return scores, [list(dict.fromkeys(self.best(0, around[i]) + self.best(1, around[i + 2]))) for i in range(len(vector))]


def neighbour_counts(vectors: DataFrame, start: int = 1, end: int = 2) -> DataFrame:
    """previous, next, n over all vectors with their ends; at most as many rows as pairs of entries."""
    whole = F.concat(F.array(F.lit(start)), F.col("vector"), F.array(F.lit(end)))
    n = F.size("vector") + 1
    pairs = vectors.select(F.explode(F.arrays_zip(F.slice(whole, 1, n).alias("previous"), F.slice(whole, 2, n).alias("next"))).alias("p"))
    return pairs.groupBy("p.previous", "p.next").agg(F.count(F.lit(1)).alias("n"))


def fixes(broken: DataFrame, counts: DataFrame, k: int = 3, first_only: bool = False) -> DataFrame:
    """The edits that make a broken Java file parse, in the order in which they are tried.

    ``broken``: hash, vector, lines. ``counts``: previous, next, n of valid files; it is bounded by the
    square of the vocabulary and read to the driver. Every candidate is written out and parsed. Files
    with a character that is no token are only mended where the edit removes or replaces it; files that
    parse have no fixes.
    """
    from corpusmill.parsers import java8

    table = {(r["previous"], r["next"]): r["n"] for r in counts.collect()}
    texts = [*SPECIAL, *(JAVA_TEXT[e] for e in JAVA_ENTRIES)]
    size = len(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Neighbours(table, size)
        for frame in frames:
            rows = []
            for key, vector, lines in zip(frame["hash"], frame["vector"], frame["lines"]):
                vector, lines = list(map(int, vector)), list(map(int, lines))
                if UNKNOWN not in vector and not java8.check(" ".join(texts[t] for t in vector).encode()):
                    continue  # nothing to mend
                for rank, step, code, i, token, original in single_fixes(vector, *model.judged(vector), k):
                    tried = edited(vector, code, i, token)
                    if UNKNOWN in tried or java8.check(" ".join(texts[t] for t in tried).encode()):
                        continue
                    rows.append((key, rank, step, code, i, token, original, lines[max(i - 1, 0) if code == "i" else i]))
                    if first_only:
                        break
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FIXES.split(", ")])
            yield out.astype({c: "Int32" for c in ("token", "original")})

    return broken.select("hash", "vector", "lines").mapInPandas(run, FIXES)
