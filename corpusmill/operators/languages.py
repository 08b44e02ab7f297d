"""Lexing and checking source code, one row per source in, rows of tokens or a summary out.

A language is passed by name; workers look it up in ``LANGUAGES``, where further ones, or other
checks, can be registered. Python is checked by the standard library, Java and JavaScript by the
recursive-descent parsers of ``corpusmill.parsers``.
"""

from __future__ import annotations

import ast
import io
import os
import re
import tokenize
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpusmill.parsers import java8, javascript


@dataclass(frozen=True)
class Token:
    name: str
    value: str
    line: int
    column: int
    end_line: int
    end_column: int


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    tokenise: Callable[[bytes], list[Token]]
    check: Callable[[bytes], bool]
    entry: Callable[[Token], str]
    physical: Callable[[Token], bool]

    def parses(self, source: bytes) -> bool:
        return self.check(source)

    def summarise(self, source: bytes, tokens: list[Token] | None = None) -> tuple[int, int]:
        """(lines that hold a token, tokens)."""
        tokens = [t for t in (self.tokenise(source) if tokens is None else tokens) if self.physical(t)]
        lines: set[int] = set()
        for t in tokens:
            if t.line == t.end_line:
                if t.name not in ("NEWLINE", "DEDENT"):
                    lines.add(t.line)
            else:
                lines.update(range(t.line, t.end_line + 1))
        return len(lines), len(tokens)


def _encoded(source: bytes | str) -> bytes:
    return source.encode("utf-8", "surrogatepass") if isinstance(source, str) else bytes(source)


def text_of(source: bytes | str) -> str:
    return source if isinstance(source, str) else bytes(source).decode("utf-8", "replace")


_UNESCAPE = re.compile(r"\\u(?:([0-9a-fA-F]{4})|\{([0-9a-fA-F]+)\})")


def unescaped(text: str) -> str:
    """Text with \\uXXXX and \\u{X..} as their characters; ValueError beyond the last code point."""
    return _UNESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)


# Python

_EXTRANEOUS = {"ENCODING", "ENDMARKER", "NL", "COMMENT", "ERRORTOKEN"}
_LAYOUT = {"INDENT", "DEDENT", "NEWLINE"}


def python_tokens(source: bytes | str) -> list[Token]:
    """Tokens of the standard library's lexer, with formatted strings folded into one STRING each, the
    empty NEWLINE it adds at the end dropped, and what it cannot read as one ERRORTOKEN."""
    data = source.encode() if isinstance(source, str) else bytes(source)
    out: list[Token] = []
    depth, start = 0, None
    try:
        for t in tokenize.tokenize(io.BytesIO(data).readline):
            name = tokenize.tok_name[t.exact_type] if t.type != tokenize.OP else "OP"
            if name == "FSTRING_START":
                depth += 1
                start = start or t
                continue
            if name == "FSTRING_END":
                depth -= 1
                if depth == 0:
                    out.append(Token("STRING", "f-string", *start.start, *t.end))
                    start = None
                continue
            if depth:
                continue
            if name == "NEWLINE" and t.string == "":
                continue
            if t.type == tokenize.OP:
                name = "ERRORTOKEN" if t.string in "$?!`" else "OP"
            elif name not in _EXTRANEOUS and name not in _LAYOUT and name not in ("NAME", "NUMBER", "STRING"):
                name = tokenize.tok_name[t.type]
            out.append(Token(name, t.string, *t.start, *t.end))
    except (tokenize.TokenError, SyntaxError, UnicodeError, LookupError, SystemError) as fault:
        if isinstance(fault, SystemError):  # the lexer gives a token although it has met a fault, as a null byte in an indented block
            if not isinstance(fault.__cause__, (SyntaxError, ValueError)):
                raise
            fault = fault.__cause__
        line = getattr(fault, "lineno", None) or (fault.args[1][0] if len(fault.args) > 1 and isinstance(fault.args[1], tuple) and isinstance(fault.args[1][0], int) else 1)
        out.append(Token("ERRORTOKEN", "", line, 0, line, 0))
    return out


def python_check(source: bytes | str) -> bool:
    """Whether the source parses."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def python_entry(token: Token) -> str:
    """Keywords, marks and layout by themselves, other tokens by class."""
    import keyword

    if token.name == "NAME":
        return token.value if keyword.iskeyword(token.value) else "<IDENTIFIER>"
    return {"NUMBER": "<NUMBER>", "STRING": "<STRING>"}.get(token.name, token.name if token.name in _LAYOUT else token.value)


# Java

# The kinds of Java's keywords and marks.
_JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient "
    "try void volatile while true false null"
).split()
_JAVA_MARKS = {
    "->": "ARROW", "::": "COLCOL", "(": "LPAREN", ")": "RPAREN", "{": "LBRACE", "}": "RBRACE", "[": "LBRACKET", "]": "RBRACKET", ";": "SEMI", ",": "COMMA", ".": "DOT",
    "...": "ELLIPSIS", "=": "EQ", ">": "GT", "<": "LT", "!": "BANG", "~": "TILDE", "?": "QUES", ":": "COLON", "==": "EQEQ", "<=": "LTEQ", ">=": "GTEQ", "!=": "BANGEQ",
    "&&": "AMPAMP", "||": "BARBAR", "++": "PLUSPLUS", "--": "SUBSUB", "+": "PLUS", "-": "SUB", "*": "STAR", "/": "SLASH", "&": "AMP", "|": "BAR", "^": "CARET",
    "%": "PERCENT", "<<": "LTLT", ">>": "GTGT", ">>>": "GTGTGT", "+=": "PLUSEQ", "-=": "SUBEQ", "*=": "STAREQ", "/=": "SLASHEQ", "&=": "AMPEQ", "|=": "BAREQ",
    "^=": "CARETEQ", "%=": "PERCENTEQ", "<<=": "LTLTEQ", ">>=": "GTGTEQ", ">>>=": "GTGTGTEQ", "@": "MONKEYS_AT",
}
_marks = "|".join(re.escape(x) for x in sorted(_JAVA_MARKS, key=len, reverse=True))
_JAVA = re.compile(
    rf"(?P<skip>\s+|/\*.*?\*/|//[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\")|(?P<char>'(?:[^'\\\n]|\\[^\n]+?)')"
    rf"|(?P<number>0[xX][\da-fA-F_.]*(?:[pP][+-]?[\d_]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[lLfFdD]?)"
    rf"|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>{_marks})|(?P<bad>.)",
    re.DOTALL,
)
_ESCAPED = re.compile(r"\\(\\|u+([0-9a-fA-F]{4}))")


def _located(pattern: re.Pattern, text: str, name: Callable[[re.Match], str | None]) -> list[Token]:
    out, line, line_start = [], 1, 0
    for m in pattern.finditer(text):
        value = m[0]
        kind = name(m)
        breaks = value.count("\n")
        end_line = line + breaks
        end_start = m.start() + value.rfind("\n") + 1 if breaks else line_start
        if kind:
            out.append(Token(kind, value, line, m.start() - line_start, end_line, m.end() - end_start))
        line, line_start = end_line, end_start
    return out


def _java_kind(m: re.Match) -> str | None:
    kind, value = m.lastgroup, m[0]
    if kind == "skip":
        return None
    if kind == "word":
        return "UNDERSCORE" if value == "_" else value.upper() if value in _JAVA_WORDS else "IDENTIFIER"
    if kind == "number":
        low = value.lower()
        hexadecimal = low.startswith("0x")
        if low.endswith("l"):
            return "LONGLITERAL"
        if low.endswith("f") and (not hexadecimal or "p" in low):
            return "FLOATLITERAL"
        if "." in low or "p" in low or (not hexadecimal and ("e" in low or low.endswith("d"))):
            return "DOUBLELITERAL"
        return "INTLITERAL"
    return {"string": "STRINGLITERAL", "char": "CHARLITERAL", "bad": "ERROR"}.get(kind) or _JAVA_MARKS[value]


def java_tokens(source: bytes | str) -> list[Token]:
    """Tokens of Java 8; \\u escapes count as what they stand for, characters of no token as ERROR."""
    text = _ESCAPED.sub(lambda m: m[0] if m[1] == "\\" else chr(int(m[2], 16)), text_of(source))
    return _located(_JAVA, text, _java_kind)


# JavaScript

_JS_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new return super "
    "switch this throw try typeof var void while with yield"
).split()
_JS_MARKS = (
    ">>>= ... === !== **= <<= >>= >>> => == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] . ; , < > + - * / % & | ^ ! ~ ? : =".split()
)
_js_marks = "|".join(re.escape(x) for x in _JS_MARKS)
_UNICODE = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_JS = re.compile(
    rf"(?P<skip>[\s\ufeff]+|/\*.*?\*/|//[^\n]*)|(?P<String>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    rf"|(?P<Numeric>0[xXbBoO][\da-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>(?:[^\W\d]|\$|{_UNICODE})(?:[\w$\u200c\u200d]|{_UNICODE})*)"
    rf"|(?P<Punctuator>{_js_marks})|(?P<ERROR>.)",
    re.DOTALL,
)
_JS_REGEXP = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[\w$]*")
_JS_TEMPLATE = re.compile(r"[`}](?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.DOTALL)
#: Words behind which a value ends; behind all others an expression begins.
_JS_VALUES = {"this", "super", "null", "true", "false"}
_JS_HEADS = {"if", "while", "for", "with"}


def _js_word(value: str) -> str:
    plain = unescaped(value) if "\\" in value else value
    return {"true": "Boolean", "false": "Boolean", "null": "Null"}.get(plain) or ("Keyword" if plain in _JS_WORDS else "Identifier")


class _Scanner:
    """Where a slash or a brace stands: what came before, and what the open brackets belong to."""

    def __init__(self) -> None:
        self.expects_value = True
        self.open: list[tuple[str, bool]] = []  # bracket, and whether a value is expected behind its end
        self.last = ""

    def token(self, kind: str, value: str) -> None:
        if kind == "Punctuator":
            if value in ("(", "[", "{"):
                if value == "(":
                    after = self.last in _JS_HEADS
                elif value == "{":  # a block, unless an operand is due here
                    after = not self.expects_value or self.last in ("", ";", "{", "}", ")", "=>", "else", "do", "try", "finally")
                else:
                    after = False
                self.open.append((value, after))
                self.expects_value = True
            elif value in (")", "]", "}"):
                self.expects_value = self.open.pop()[1] if self.open else value == "}"
            else:
                self.expects_value = value not in ("++", "--") or self.expects_value
        elif kind == "Keyword":
            self.expects_value = value not in _JS_VALUES
        else:
            self.expects_value = False
        self.last = value


def without_shebang(text: str) -> str:
    """The text with a first line for the shell emptied, so that lines keep their numbers."""
    return re.sub(r"\A#![^\r\n]+", "", text)


def javascript_tokens(source: bytes | str) -> list[Token]:
    """Tokens by class, characters of no token as ERROR. A slash begins a regular expression where an
    operand is due; a template is one token, or its parts around the expressions in it."""
    text = without_shebang(text_of(source))
    out: list[Token] = []
    scanner, templates = _Scanner(), []  # for each open template, the brackets open around its expression
    at, line, line_start = 0, 1, 0
    while at < len(text):
        c = text[at]
        found, kind = None, ""
        if c == "/" and scanner.expects_value:
            found, kind = _JS_REGEXP.match(text, at), "RegularExpression"
        elif c == "`" or (c == "}" and templates and templates[-1] == len(scanner.open)):
            found, kind = _JS_TEMPLATE.match(text, at), "Template"
            if found and c == "}":
                templates.pop()
            if found and found[0][-1] == "{":
                templates.append(len(scanner.open))
        if not found:
            found = _JS.match(text, at)
            kind = _js_word(found[0]) if found.lastgroup == "word" else found.lastgroup
        value, at = found[0], found.end()
        breaks = value.count("\n")
        end_line = line + breaks
        end_start = found.start() + value.rfind("\n") + 1 if breaks else line_start
        if kind != "skip":
            out.append(Token(kind, value, line, found.start() - line_start, end_line, at - end_start))
            scanner.token(kind, value)
            if kind == "Template" and value[-1] == "{":
                scanner.expects_value = True
        line, line_start = end_line, end_start
    return out


# Vocabulary entries of the classes of tokens.
_JS_ENTRIES = {"Identifier": "<IDENTIFIER>", "Numeric": "<NUMBER>", "String": "<STRING>", "RegularExpression": "<REGEXP>"}
# Vocabulary entries of templates, by whether the part begins and ends the template.
_JS_TEMPLATES = {
    (True, True): "<STANDALONE-TEMPLATE>", (True, False): "<TEMPLATE-HEAD>",
    (False, False): "<TEMPLATE-MIDDLE>", (False, True): "<TEMPLATE-TAIL>",
}


def javascript_entry(token: Token) -> str:
    """Vocabulary entry of a token: words and marks by themselves, escapes resolved, all else by class.
    TypeError for an unknown class."""
    if token.name == "Template":
        return _JS_TEMPLATES[token.value[0] == "`", token.value[-1] == "`"]
    if token.name in _JS_ENTRIES:
        return _JS_ENTRIES[token.name]
    if token.name not in ("Boolean", "Keyword", "Null", "Punctuator"):
        raise TypeError(token.name)
    return unescaped(token.value)


def javascript_vocabulary() -> list[str]:
    """All entries that a token can have, in order."""
    return sorted({*_JS_WORDS, "true", "false", "null", *_JS_MARKS, *_JS_ENTRIES.values(), *_JS_TEMPLATES.values()})


LANGUAGES: dict[str, Language] = {
    "python": Language("python", (".py",), python_tokens, python_check, python_entry, lambda t: t.name not in _EXTRANEOUS),
    "java": Language("java", (".java",), java_tokens, lambda source: not java8.check(_encoded(source)), lambda t: t.name, lambda t: True),
    "javascript": Language("javascript", (".js",), javascript_tokens, lambda source: not javascript.check(_encoded(source)), javascript_entry, lambda t: True),
}


def language(name: str) -> Language:
    """A language by name; KeyError says which there are."""
    if name not in LANGUAGES:
        raise KeyError(f"{name}: one of {', '.join(sorted(LANGUAGES))}")
    return LANGUAGES[name]


_chosen: list[str] = []
#: Environment variable that names the language where none was chosen.
VARIABLE = "CORPUSMILL_LANGUAGE"


def choose(name: str) -> Language:
    """Makes a language the default of this process."""
    found = language(name)
    _chosen[:] = [name]
    return found


def chosen() -> Language:
    """The default language: the one chosen, or else the environment's; LookupError where there is none."""
    name = _chosen[0] if _chosen else os.environ.get(VARIABLE, "")
    if not name:
        raise LookupError(f"no language chosen and {VARIABLE} is not set")
    return language(name)


def forget() -> None:
    """Drops the choice."""
    _chosen.clear()


def register_check(name: str, check: Callable[[bytes], bool]) -> None:
    """Puts another syntax check in the place of a language's own."""
    LANGUAGES[name] = replace(language(name), check=check)


TOKEN_ROWS = "hash string, pos int, name string, value string, line int, column int, end_line int, end_column int, entry string"


#: Tokens of a frame that a worker gives back, beside those of its last source; bounds the worker's memory.
AT_ONCE = 20_000


def _entry(lang: Language, token: Token) -> str:
    return lang.entry(token) if token.name not in ("ERROR", "ERRORTOKEN") else "<UNK>"


def _token_frames(frames: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
    lang = language(name)
    columns = [c.split()[0] for c in TOKEN_ROWS.split(", ")]
    for frame in frames:
        rows: list[tuple] = []
        for key, source in zip(frame["hash"], frame["source"]):
            rows += [(key, i, t.name, t.value, t.line, t.column, t.end_line, t.end_column, _entry(lang, t)) for i, t in enumerate(lang.tokenise(bytes(source or b"")))]
            if len(rows) >= AT_ONCE:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def tokenised(sources: DataFrame, name: str) -> DataFrame:
    """A row per token of every source (hash, source)."""
    return sources.select("hash", "source").mapInPandas(lambda frames: _token_frames(frames, name), TOKEN_ROWS)


def _entry_frames(frames: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
    lang = language(name)
    for frame in frames:
        counts: Counter[str] = Counter()
        for source in frame["source"]:
            counts.update(_entry(lang, t) for t in lang.tokenise(bytes(source or b"")))
        yield pd.DataFrame({"entry": list(counts), "n": list(counts.values())}).astype({"entry": "object", "n": "int64"})


def entry_counts(sources: DataFrame, name: str) -> DataFrame:
    """entry, n: tokens of all sources (hash, source) by entry. They are counted where they are lexed, so a
    worker holds the tokens of one source."""
    return sources.select("source").mapInPandas(lambda frames: _entry_frames(frames, name), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def parsed(sources: DataFrame) -> DataFrame:
    """hash, language, sloc, n_tokens, reason of sources (hash, source, language): a summary of those
    that parse, a reason for the others. One pass gives both tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, source, name in zip(frame["hash"], frame["source"], frame["language"]):
                data = bytes(source or b"")
                lang = language(name)
                if lang.parses(data):
                    sloc, n = lang.summarise(data)
                    rows.append((key, name, sloc, n, None))
                else:
                    rows.append((key, name, None, None, "Syntax error"))
            out = pd.DataFrame(rows, columns=["hash", "language", "sloc", "n_tokens", "reason"])
            yield out.astype({"sloc": "Int32", "n_tokens": "Int32"})

    return sources.select("hash", "source", "language").mapInPandas(run, "hash string, language string, sloc int, n_tokens int, reason string")


def language_of(path: Column) -> Column:
    """Language whose ending a path has, as stored; null for none."""
    out = F.lit(None).cast("string")
    for lang in LANGUAGES.values():
        for ending in lang.extensions:
            out = F.when(path.endswith(ending), lang.name).otherwise(out)
    return out


@pandas_udf(T.StringType())
def unescape_unicode(texts: pd.Series) -> pd.Series:
    """Text with \\uXXXX and \\u{X..} as their characters; an error beyond the last code point."""
    return texts.map(lambda t: None if t is None else unescaped(t))


@pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """One byte for each index; an error for one above 255."""
    return vectors.map(lambda v: None if v is None else bytes(list(v)))


@pandas_udf(T.ArrayType(T.IntegerType()))
def from_bytes(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: None if b is None else list(bytes(b)))
