"""Java 8: recursive-descent declarations and statements, precedence-climbing expressions, panic-mode recovery."""

from __future__ import annotations

import re

from corpusmill.parsers.base import BAD, END, Descent, Kinds, Shapes, SyntaxFault, allow, private

_LEX = re.compile(
    r"/\*.*?\*/|//[^\n\r]*"
    r"|\"(?:[^\"\\\n\r]|\\.)*\"|'(?:[^'\\\n\r]|\\[^\n\r]+?)'"
    r"|0[xX][0-9a-fA-F_.]*(?:[pP][+-]?[0-9_]+)?\w*|(?:\d\w*(?:\.(?:\d\w*|[eEfFdD]\w*)?)?|\.\d\w*)(?:(?<=[eE])[+-]\d\w*)?"
    r"|[$\w]+"
    r"|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|<<|\+=|-=|\*=|/=|&=|\|=|\^=|%="
    r"|[^ \t\f\n\r]",
    re.DOTALL,
)
# The keywords of Java 8.
_KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float "
    "for goto if implements import instanceof int interface long native new package private protected public return short static "
    "strictfp super switch synchronized this throw throws transient try void volatile while true false null"
).split()
_LONG = "... -> :: ++ -- && || == != <= >= <<= << += -= *= /= &= |= ^= %=".split()
_K = private(_KEYWORDS + _LONG, 0xE000)
_NUMBER = re.compile(
    r"0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*[lL]?|0[bB][01](?:_*[01])*[lL]?|0(?:_*[0-7])*[lL]?|[1-9](?:_*\d)*[lL]?"
    r"|(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[fFdD]?|\d(?:_*\d)*(?:[eE][+-]?\d(?:_*\d)*[fFdD]?|[fFdD])"
    r"|0[xX](?:[0-9a-fA-F_]+\.?|[0-9a-fA-F_]*\.[0-9a-fA-F_]+)[pP][+-]?\d+[fFdD]?"
)
_CHAR = re.compile(r"'(?:[^'\\]|\\(?:[btnfr\"'\\]|[0-3]?[0-7]{1,2}))'")
_STRING_ESCAPE = re.compile(r"\\(?:[btnfr\"'\\0-7]|(.))", re.DOTALL)
_UNICODE = re.compile(r"\\(\\|u+([0-9a-fA-F]{4}))")
_SINGLE = frozenset("+-*/%&|^~!<>=()[]{},:;.?@")


def _too_large(text: str) -> bool:
    """Whether a whole number exceeds its type; the least int and long stand behind a minus."""
    digits = text.replace("_", "").lower()
    long_ = digits.endswith("l")
    digits = digits.rstrip("l")
    if digits.isdecimal() and digits[0] != "0":
        return int(digits) > (1 << 63 if long_ else 1 << 31)
    if digits[:2] == "0x" and all(c in "0123456789abcdef" for c in digits[2:]):
        return int(digits, 16) >= (1 << 64 if long_ else 1 << 32)
    return False


def _classify(text: str) -> tuple[str, bool]:
    c = text[0]
    if c == "/" and len(text) > 1 and text[1] in "/*":
        return "", False
    if c == '"' and len(text) > 1:
        return (BAD if "\\" in text and any(m[1] for m in _STRING_ESCAPE.finditer(text)) else "s"), False
    if c == "'" and len(text) > 1:
        return ("s" if _CHAR.fullmatch(text) else BAD), True
    if c.isdigit() or (c == "." and len(text) > 1 and text != "..."):
        return ("0" if _NUMBER.fullmatch(text) and not _too_large(text) else BAD), True
    if c in "$_" or c.isalpha() or text.isidentifier():
        return ("n" if text.replace("$", "_").isidentifier() else BAD), True
    return (c if c in _SINGLE else BAD), True


_kinds = Kinds(_K, _classify)
_KIND = _kinds.__getitem__
_PRIMITIVE = frozenset(_K[w] for w in ("boolean", "byte", "char", "double", "float", "int", "long", "short"))
_MODIFIER = frozenset(
    _K[w] for w in ("abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile")
)
_TYPES = frozenset(_K[w] for w in ("class", "interface", "enum"))


def _levels(table: list[str]) -> dict[str, int]:
    return {_K.get(c, c): level for level, row in enumerate(table, 1) for c in row.split()}


_BINARY = _levels(["||", "&&", "|", "^", "&", "== !=", "< > <= >= instanceof", "<<", "+ -", "* / %"])
_SHIFT = _BINARY[_K["<<"]]
_ASSIGN = frozenset(["=", *(_K[c] for c in ("<<=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%="))])
_VALUES = frozenset(["0", "s", *(_K[w] for w in ("this", "true", "false", "null"))])
_CAST_BEGINS = frozenset(["n", "0", "s", "(", "!", "~", *(_K[w] for w in ("this", "super", "new", "true", "false", "null", "void")), *_PRIMITIVE])
# What an expression is as a statement and as a target: neither, a target, a statement.
_PLAIN, _PLACE, _ACTION = 0, 1, 2
_simple, _heads, _for_heads, _fields, _heads_of_methods = Shapes(), Shapes(), Shapes(), Shapes(), Shapes()
_CONTROL = frozenset(["{", *(_K[w] for w in ("if", "while", "for", "do", "try", "switch", "synchronized"))])


class _Parser(Descent):
    def end(self) -> None:
        self.need(";")

    def name(self, what: str = "<identifier>") -> None:
        if self.k[self.i] != "n":
            self.fail(f"{what} expected")
        self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.k[self.i] == "." and self.k[self.i + 1] == "n":
            self.i += 2

    # types

    def type_end(self, i: int, dims: bool = True, diamond: bool = False) -> int:
        """Behind the type that begins at ``i``, or -1; ``<>`` only where ``diamond`` says so."""
        k = self.k
        while k[i] == "@" and k[i + 1] == "n":
            i = self.annotation_end(i)
        if k[i] in _PRIMITIVE:
            i += 1
        elif k[i] == "n":
            while True:
                i += 1
                if k[i] == "<":
                    i = self.arguments_end(i, diamond)
                    if i < 0:
                        return -1
                if k[i] != ".":
                    break
                j = i + 1
                while k[j] == "@" and k[j + 1] == "n":
                    j = self.annotation_end(j)
                if k[j] != "n":
                    break
                i = j
        else:
            return -1
        while dims:
            j = i
            while k[j] == "@" and k[j + 1] == "n":
                j = self.annotation_end(j)
            if k[j] != "[" or k[j + 1] != "]":
                break
            i = j + 2
        return i

    def arguments_end(self, i: int, diamond: bool = False) -> int:
        """Behind the type arguments whose < is at ``i``, or -1."""
        k = self.k
        i += 1
        if k[i] == ">":
            return i + 1 if diamond else -1
        while True:
            while k[i] == "@" and k[i + 1] == "n":
                i = self.annotation_end(i)
            if k[i] == "?":
                i += 1
                if k[i] == _K["extends"] or k[i] == _K["super"]:
                    i = self.type_end(i + 1)
            else:
                i = self.type_end(i)
            if i < 0:
                return -1
            if k[i] == ">":
                return i + 1
            if k[i] != ",":
                return -1
            i += 1

    def annotation_end(self, i: int) -> int:
        saved, self.i = self.i, i
        self.annotation()
        i, self.i = self.i, saved
        return i

    def type(self, dims: bool = True, diamond: bool = False) -> None:
        end = self.type_end(self.i, dims, diamond)
        if end < 0:
            self.fail("<identifier> expected")
        self.i = end

    def dims(self) -> None:
        while self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            self.i += 2

    def type_list(self) -> None:
        self.type()
        while self.k[self.i] == ",":
            self.i += 1
            self.type()

    def type_parameters(self) -> None:
        if self.k[self.i] != "<":
            return
        self.i += 1
        while True:
            self.annotations()
            self.name()
            if self.k[self.i] == _K["extends"]:
                self.i += 1
                self.type()
                while self.k[self.i] == "&":
                    self.i += 1
                    self.type()
            if self.k[self.i] != ",":
                break
            self.i += 1
        self.need(">")

    # annotations and modifiers

    def annotation(self) -> None:
        self.i += 1
        self.dotted()
        if self.k[self.i] != "(":
            return
        self.i += 1
        while self.k[self.i] != ")":
            if self.k[self.i] == "n" and self.k[self.i + 1] == "=":
                self.i += 2
            self.element()
            if self.k[self.i] == ",":
                self.i += 1
                if self.k[self.i] == ")":
                    self.fail("illegal start of expression")
            elif self.k[self.i] != ")":
                self.fail("')' expected")
        self.i += 1

    def element(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.k[self.i] == "{":
            self.i += 1
            while self.k[self.i] != "}":
                self.element()
                if self.k[self.i] == ",":
                    self.i += 1
                elif self.k[self.i] != "}":
                    self.fail("'}' expected")
            self.i += 1
        else:
            self.ternary()

    def annotations(self) -> None:
        while self.k[self.i] == "@" and self.k[self.i + 1] == "n":
            self.annotation()

    def modifiers(self) -> None:
        while True:
            c = self.k[self.i]
            if c in _MODIFIER:
                if c == _K["default"] and self.k[self.i + 1] == ":":
                    return
                self.i += 1
            elif c == "@" and self.k[self.i + 1] == "n":
                self.annotation()
            else:
                return

    # declarations

    def unit(self) -> None:
        k = self.k
        start = self.i
        try:
            self.annotations()
            if k[self.i] == _K["package"]:
                self.i += 1
                self.dotted()
                self.end()
            else:
                self.i = start
        except SyntaxFault as fault:
            self.panic(fault, start)
        while k[self.i] != END:
            start = self.i
            try:
                if k[self.i] == ";":
                    self.i += 1
                elif k[self.i] == _K["import"]:
                    self.import_()
                else:
                    self.modifiers()
                    if not self.type_declaration():
                        self.fail("class, interface, or enum expected")
            except SyntaxFault as fault:
                self.panic(fault, start)
                if k[self.i] == "}":
                    self.i += 1

    def import_(self) -> None:
        self.i += 1
        if self.k[self.i] == _K["static"]:
            self.i += 1
        self.dotted()
        if self.k[self.i] == "." and self.k[self.i + 1] == "*":
            self.i += 2
        self.end()

    def type_declaration(self) -> bool:
        k = self.k
        c = k[self.i]
        if c == _K["class"]:
            self.i += 1
            self.name()
            self.type_parameters()
            if k[self.i] == _K["extends"]:
                self.i += 1
                self.type()
            if k[self.i] == _K["implements"]:
                self.i += 1
                self.type_list()
            self.body()
        elif c == _K["interface"]:
            self.i += 1
            self.name()
            self.type_parameters()
            if k[self.i] == _K["extends"]:
                self.i += 1
                self.type_list()
            self.body()
        elif c == "@" and k[self.i + 1] == _K["interface"]:
            self.i += 2
            self.name()
            self.body()
        elif c == _K["enum"]:
            self.i += 1
            self.name()
            if k[self.i] == _K["implements"]:
                self.i += 1
                self.type_list()
            self.enum_body()
        else:
            return False
        return True

    def body(self) -> None:
        self.need("{", "'{'")
        self.members()

    def members(self) -> None:
        k = self.k
        while True:
            c = k[self.i]
            if c == "}":
                self.i += 1
                return
            if c == END:
                self.fail("reached end of file while parsing")
            start = self.i
            try:
                self.member()
            except SyntaxFault as fault:
                self.panic(fault, start)

    def enum_body(self) -> None:
        k = self.k
        self.need("{", "'{'")
        while k[self.i] not in ";}":
            self.annotations()
            self.name()
            if k[self.i] == "(":
                self.arguments()
            if k[self.i] == "{":
                self.body()
            if k[self.i] == ",":
                self.i += 1
            elif k[self.i] not in ";}":
                self.fail("',', '}', or ';' expected")
        if k[self.i] == ";":
            self.i += 1
            self.members()
        else:
            self.i += 1

    def member(self) -> None:
        k, start = self.k, self.i
        c = k[start]
        if c == ";":
            self.i += 1
            return
        stop = k.find(";", start) + 1
        if 0 < stop - start <= 160 and k[start:stop] in _fields:
            self.i = stop
            return
        if c == "{":
            return self.block()
        if c == _K["static"] and k[start + 1] == "{":
            self.i += 1
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        self.annotations()
        if k[self.i] == "n" and k[self.i + 1] == "(":
            self.i += 1
            self.method_rest(True)
            return
        if k[self.i] == _K["void"]:
            self.i += 1
            self.name()
            self.method_rest(False)
            return
        self.type()
        self.name()
        if k[self.i] == "(":
            self.method_rest(False)
            return
        self.declarators()
        self.end()
        if self.i == stop and "{" not in k[start:stop] and "}" not in k[start:stop]:
            _fields.learn(k[start:stop])

    def method_rest(self, constructor: bool) -> None:
        k, start = self.k, self.i
        stop = k.find("{", start)
        if stop > 0 and k[start:stop] in _heads_of_methods:
            self.i = stop
            return self.block()
        self.need("(")
        if k[self.i] != ")":
            while True:
                self.modifiers()
                self.type()
                self.annotations()
                if k[self.i] == _K["..."]:
                    self.i += 1
                if k[self.i] == _K["this"]:
                    self.i += 1
                else:
                    self.name()
                    if k[self.i] == "." and k[self.i + 1] == _K["this"]:
                        self.i += 2
                self.dims()
                if k[self.i] != ",":
                    break
                self.i += 1
        self.need(")", "')'")
        self.dims()
        if k[self.i] == _K["throws"]:
            self.i += 1
            self.type_list()
        if k[self.i] == "{":
            if self.i == stop:
                _heads_of_methods.learn(k[start:stop])
            return self.block()
        if constructor:
            self.fail("'{' expected")
        if k[self.i] == _K["default"]:
            self.i += 1
            self.element()
        self.need(";", "'{' or ';'")

    def declarators(self) -> None:
        """Behind the first name of a field or variable."""
        while True:
            self.dims()
            if self.k[self.i] == "=":
                self.i += 1
                self.initializer()
            if self.k[self.i] != ",":
                return
            self.i += 1
            self.name()

    def initializer(self) -> None:
        if self.k[self.i] != "{":
            self.expression()
            return
        self.i += 1
        while self.k[self.i] != "}":
            self.initializer()
            if self.k[self.i] == ",":
                self.i += 1
            elif self.k[self.i] != "}":
                self.fail("'}' expected")
        self.i += 1

    # statements

    def block(self) -> None:
        k = self.k
        self.need("{", "'{'")
        while True:
            c = k[self.i]
            if c == "}":
                self.i += 1
                return
            if c == END:
                self.fail("reached end of file while parsing")
            start = self.i
            try:
                self.block_statement()
            except SyntaxFault as fault:
                self.panic(fault, start)

    def block_statement(self) -> None:
        k, start = self.k, self.i
        stop = k.find(";", start) + 1
        if 0 < stop - start <= 160 and k[start:stop] in _simple:
            self.i = stop
            return
        c = k[start]
        if c == "n" or c in _PRIMITIVE:
            end = self.type_end(start)
            if end > 0 and k[end] == "n":
                self.i = end + 1
                if k[self.i] in "=;,[:":
                    self.declarators()
                    self.end()
                    self.learn(start, stop)
                    return
                self.i = start
                if not (c == "n" and k[start + 1] == ":"):
                    self.i = end + 1
                    self.fail("';' expected")
            elif c in _PRIMITIVE and not (end > 0 and (k[end] in ".(" or k[end] == _K["::"])):
                self.i = end if end > 0 else start
                self.fail("not a statement")
        elif c == "@" or c == _K["final"] or c == _K["abstract"] or c == _K["static"] or c == _K["strictfp"] or c in _TYPES:
            self.modifiers()
            if self.type_declaration():
                return
            self.type()
            self.name()
            self.declarators()
            self.end()
            self.learn(start, stop)
            return
        self.statement()
        self.learn(start, stop)

    def learn(self, start: int, stop: int) -> None:
        # a control statement may go on behind its semicolon, with an else for one
        if self.k[start] in _CONTROL or self.k[start + 1] == ":":
            return
        if stop and self.i == stop and "{" not in self.k[start:stop] and "}" not in self.k[start:stop]:
            _simple.learn(self.k[start:stop])

    def statement(self) -> None:
        k = self.k
        c = k[self.i]
        handler = _STATEMENTS.get(c)
        if handler is not None:
            handler(self)
        elif c == "n" and k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            start = self.i
            if self.expression() != _ACTION:
                self.fail("not a statement", start)
            self.end()

    def nothing(self) -> None:
        self.i += 1

    def head(self) -> None:
        start = self.i
        stop = self.k.find("{", start)
        if stop > 0 and self.k[start:stop] in _heads:
            self.i = stop
            return
        self.need("(", "'('")
        self.expression()
        self.need(")", "')'")
        if self.i == stop:
            _heads.learn(self.k[start:stop])

    def if_(self) -> None:
        self.i += 1
        self.head()
        self.statement()
        if self.k[self.i] == _K["else"]:
            self.i += 1
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.head()
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need(_K["while"], "'while'")
        self.need("(", "'('")
        self.expression()
        self.need(")", "')'")
        self.end()

    def local(self) -> bool:
        """Type and name of a local variable, if one begins here."""
        start = self.i
        self.modifiers()
        end = self.type_end(self.i)
        if end > 0 and self.k[end] == "n" and self.k[end + 1] in "=;,[:":
            self.i = end + 1
            return True
        if self.i != start:
            self.fail("<identifier> expected")
        return False

    def for_(self) -> None:
        k = self.k
        self.i += 1
        start = self.i
        stop = k.find("{", start)
        if stop > 0 and k[start:stop] in _for_heads:
            self.i = stop
            return self.statement()
        self.need("(", "'('")
        each = False
        if k[self.i] != ";":
            if self.local():
                if k[self.i] == ":":
                    each = True
                    self.i += 1
                    self.expression()
                else:
                    self.declarators()
            else:
                self.actions()
        if not each:
            self.need(";", "';'")
            if k[self.i] != ";":
                self.expression()
            self.need(";", "';'")
            if k[self.i] != ")":
                self.actions()
        self.need(")", "')'")
        if self.i == stop:
            _for_heads.learn(k[start:stop])
        self.statement()

    def actions(self) -> None:
        while True:
            start = self.i
            if self.expression() != _ACTION:
                self.fail("not a statement", start)
            if self.k[self.i] != ",":
                return
            self.i += 1

    def try_(self) -> None:
        k = self.k
        self.i += 1
        found = False
        if k[self.i] == "(":
            found = True
            self.i += 1
            while True:
                if not self.local():
                    self.fail("<identifier> expected")
                self.need("=", "'='")
                self.expression()
                if k[self.i] == ";":
                    self.i += 1
                    if k[self.i] == ")":
                        break
                elif k[self.i] == ")":
                    break
                else:
                    self.fail("')' expected")
            self.i += 1
        self.block()
        while k[self.i] == _K["catch"]:
            found = True
            self.i += 1
            self.need("(", "'('")
            self.modifiers()
            self.type()
            while k[self.i] == "|":
                self.i += 1
                self.type()
            self.name()
            self.need(")", "')'")
            self.block()
        if k[self.i] == _K["finally"]:
            found = True
            self.i += 1
            self.block()
        if not found:
            self.fail("'try' without 'catch', 'finally' or resource declarations")

    def switch(self) -> None:
        k = self.k
        self.i += 1
        self.head()
        self.need("{", "'{'")
        while k[self.i] != "}":
            if k[self.i] == _K["case"]:
                self.i += 1
                self.ternary()
            elif k[self.i] == _K["default"]:
                self.i += 1
            else:
                self.fail("case, default, or '}' expected")
            self.need(":", "':'")
            while k[self.i] != "}" and k[self.i] != _K["case"] and k[self.i] != _K["default"]:
                if k[self.i] == END:
                    self.fail("reached end of file while parsing")
                start = self.i
                try:
                    self.block_statement()
                except SyntaxFault as fault:
                    self.panic(fault, start)
        self.i += 1

    def synchronized(self) -> None:
        self.i += 1
        self.head()
        self.block()

    def return_(self) -> None:
        self.i += 1
        if self.k[self.i] != ";":
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.end()

    def jump(self) -> None:
        self.i += 1
        if self.k[self.i] == "n":
            self.i += 1
        self.end()

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.k[self.i] == ":":
            self.i += 1
            self.expression()
        self.end()

    # expressions

    def expression(self) -> int:
        kind = self.ternary()
        k = self.k
        c = k[self.i]
        if c in _ASSIGN or (c == ">" and k[self.i + 1] in (">", _K[">="])):
            if c == ">":  # >>= and >>>= come apart, as types need them
                j = self.i
                while k[j] == ">":
                    j += 1
                if k[j] != _K[">="] or j - self.i > 2:
                    self.fail("illegal start of expression")
                self.i = j
            self.i += 1
            self.expression()
            return _ACTION
        return kind

    def ternary(self) -> int:
        kind = self.binary(1)
        if self.k[self.i] == "?":
            self.i += 1
            self.ternary_branch()
            self.need(":", "':'")
            self.ternary_branch()
            return _PLAIN
        return kind

    def ternary_branch(self) -> None:
        self.expression()

    def binary(self, least: int) -> int:
        k = self.k
        kind = self.unary()
        while True:
            c = k[self.i]
            level = _BINARY.get(c)
            if level is None:
                return kind
            if c == ">" and k[self.i + 1] == ">":
                width = 3 if k[self.i + 2] == ">" else 2
                if k[self.i + width] == _K[">="]:
                    return kind
                level = _SHIFT
            elif c == ">" and k[self.i + 1] == _K[">="]:
                return kind
            else:
                width = 1
            if level < least:
                return kind
            self.i += width
            if c == _K["instanceof"]:
                self.type()
            else:
                self.binary(level + 1)
            kind = _PLAIN

    def unary(self) -> int:
        k = self.k
        c = k[self.i]
        if c == _K["++"] or c == _K["--"]:
            self.i += 1
            self.unary()
            return _ACTION
        if c in "+-!~":
            self.i += 1
            self.unary()
            return _PLAIN
        if c == "(":
            end = self.type_end(self.i + 1)
            if end > 0:
                primitive = k[self.i + 1] in _PRIMITIVE
                while k[end] == "&" and not primitive:
                    end = self.type_end(end + 1)
                    if end < 0:
                        break
                if end > 0 and k[end] == ")" and k[end + 1] != _K["->"]:
                    if (primitive and (k[end - 1] != "]" or k[end + 1] in _CAST_BEGINS or True)) or k[end + 1] in _CAST_BEGINS:
                        self.i = end + 1
                        self.unary()
                        return _PLAIN
        kind = self.primary()
        while True:
            c = k[self.i]
            if c == ".":
                kind = self.selector()
            elif c == "[":
                self.i += 1
                self.expression()
                self.need("]", "']'")
                kind = _PLACE
            elif c == _K["::"]:
                self.i += 1
                if k[self.i] == "<":
                    self.i = self.arguments_end(self.i)
                    if self.i < 0:
                        self.fail("illegal start of expression", 0)
                if k[self.i] == _K["new"]:
                    self.i += 1
                else:
                    self.name()
                kind = _PLAIN
            elif c == _K["++"] or c == _K["--"]:
                self.i += 1
                kind = _ACTION
            else:
                return kind

    def selector(self) -> int:
        k = self.k
        self.i += 1
        c = k[self.i]
        if c == "n":
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return _ACTION
            return _PLACE
        if c == _K["new"]:
            self.i += 1
            self.annotations()
            self.name()
            if k[self.i] == "<":
                self.i = max(self.arguments_end(self.i, True), self.i)
            self.arguments()
            if k[self.i] == "{":
                self.body()
            return _ACTION
        if c == "<":
            end = self.arguments_end(self.i)
            if end < 0:
                self.fail("illegal start of type")
            self.i = end
            if k[self.i] == _K["super"]:
                self.i += 1
            else:
                self.name()
            self.arguments()
            return _ACTION
        if c == _K["super"]:
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return _ACTION
            return _PLAIN
        if c == _K["this"] or c == _K["class"]:
            self.i += 1
            return _PLAIN
        self.fail("<identifier> expected")
        return _PLAIN

    def arguments(self) -> None:
        self.need("(", "'('")
        if self.k[self.i] == ")":
            self.i += 1
            return
        while True:
            self.expression()
            if self.k[self.i] != ",":
                break
            self.i += 1
        self.need(")", "')' or ','")

    def lambda_body(self) -> int:
        self.need(_K["->"], "->")
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()
        return _PLAIN

    def primary(self) -> int:
        k = self.k
        c = k[self.i]
        if c == "n":
            if k[self.i + 1] == _K["->"]:
                self.i += 1
                return self.lambda_body()
            end = -1
            if k[self.i + 1] == "<" or k[self.i + 1] == "[" or k[self.i + 1] == ".":
                end = self.type_end(self.i)
                # Type<..>::x, Type[]::x and Type[].class
                if not (end > 0 and (k[end - 1] in "]>") and (k[end] == _K["::"] or (k[end] == "." and k[end + 1] == _K["class"]))):
                    end = -1
            if end > 0:
                self.i = end
                return _PLAIN
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return _ACTION
            return _PLACE
        if c in _VALUES:
            self.i += 1
            if c == _K["this"] and k[self.i] == "(":
                self.arguments()
                return _ACTION
            return _PLAIN
        if c == "(":
            if self.lambda_ahead():
                self.lambda_parameters()
                return self.lambda_body()
            self.i += 1
            kind = self.expression()
            self.need(")", "')'")
            return _PLACE if kind == _PLACE else _PLAIN
        if c == _K["new"]:
            return self.new()
        if c == _K["super"]:
            self.i += 1
            if k[self.i] == "(":
                self.arguments()
                return _ACTION
            if k[self.i] != "." and k[self.i] != _K["::"]:
                self.fail("'.' expected")
            return _PLAIN
        if c in _PRIMITIVE or c == _K["void"]:
            end = self.i + 1 if c == _K["void"] else self.type_end(self.i)
            if (k[end] == "." and k[end + 1] == _K["class"]) or (k[end] == _K["::"] and k[end - 1] == "]"):
                self.i = end
                return _PLAIN
            self.i = end
            self.fail("'.class' expected")
        if c == "@":
            self.fail("illegal start of expression")
        self.fail("reached end of file while parsing" if c == END else "illegal start of expression")
        return _PLAIN

    def lambda_ahead(self) -> bool:
        k, i, depth = self.k, self.i, 0
        while True:
            c = k[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
                if depth == 0:
                    return k[i + 1] == _K["->"]
            elif c in "{};" or c == END:
                return False
            i += 1

    def lambda_parameters(self) -> None:
        k = self.k
        self.i += 1
        if k[self.i] == ")":
            self.i += 1
            return
        if k[self.i] == "n" and k[self.i + 1] in ",)":
            while True:
                self.name()
                if k[self.i] != ",":
                    break
                self.i += 1
        else:
            while True:
                self.modifiers()
                self.type()
                if k[self.i] == _K["..."]:
                    self.i += 1
                self.name()
                self.dims()
                if k[self.i] != ",":
                    break
                self.i += 1
        self.need(")", "')'")

    def new(self) -> int:
        k = self.k
        self.i += 1
        if k[self.i] == "<":
            self.i = max(self.arguments_end(self.i), self.i)
        self.annotations()
        primitive = k[self.i] in _PRIMITIVE
        self.type(False, True)
        if k[self.i] == "[" or (k[self.i] == "@" and primitive):
            sized = False
            while k[self.i] == "[":
                self.i += 1
                if k[self.i] == "]":
                    self.i += 1
                    if not sized and k[self.i] != "[" and k[self.i] != "{":
                        self.fail("array dimension missing")
                    if not sized and k[self.i] == "{":
                        self.initializer()
                        return _PLAIN
                else:
                    if k[self.i - 2] == "]" and k[self.i - 3] == "[":
                        return self.index_after_new()
                    sized = True
                    self.expression()
                    self.need("]", "']'")
            return _PLAIN
        if primitive:
            self.fail("'[' expected")
        if k[self.i] != "(":
            self.fail("'(' or '[' expected")
        self.arguments()
        if k[self.i] == "{":
            self.body()
        return _ACTION

    def index_after_new(self) -> int:
        self.expression()
        self.need("]", "']'")
        return _PLAIN


_STATEMENTS = {
    "{": _Parser.block, ";": _Parser.nothing, _K["if"]: _Parser.if_, _K["while"]: _Parser.while_, _K["do"]: _Parser.do, _K["for"]: _Parser.for_,
    _K["try"]: _Parser.try_, _K["switch"]: _Parser.switch, _K["synchronized"]: _Parser.synchronized, _K["return"]: _Parser.return_,
    _K["throw"]: _Parser.throw, _K["break"]: _Parser.jump, _K["continue"]: _Parser.jump, _K["assert"]: _Parser.assert_,
}


def kinds_of(text: str) -> str:
    return "".join(map(_KIND, _LEX.findall(text)))


def readable(source: bytes) -> str:
    """The text, bad bytes replaced, a byte order mark and a closing control-Z dropped, \\u escapes resolved."""
    text = source.decode("utf-8", "replace")
    if text[:1] == "\ufeff":
        text = text[1:]
    if text[-1:] == "\x1a":
        text = text[:-1]
    if "\\u" in text:
        text = _UNICODE.sub(lambda m: m[0] if m[1] == "\\" else chr(int(m[2], 16)), text)
    return text


def check(source: bytes) -> list[tuple[int, str]]:
    """Syntax errors as (line, message), by line; empty for a source that parses."""
    text = readable(source)
    try:
        kinds = kinds_of(text)
        allow(len(kinds))
        parser = _Parser(kinds)
        parser.unit()
    except RecursionError:
        return [(1, "nested too deeply")]
    if not parser.errors:
        return []
    starts = [m.start() for m in _LEX.finditer(text) if _KIND(m[0])]
    return sorted((text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1, message) for at, message in parser.errors)
