"""Python 3 (3.13): statements by recursive descent over logical lines, expressions by precedence climbing."""

from __future__ import annotations

import codecs
import re
import unicodedata

from corpusmill.parsers.base import BAD, END, Kinds, SyntaxFault, allow, private

_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_FIELD = r"\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\}"
_LEX = re.compile(
    rf"""[ \t\f]*(?:\#[^\n]*)?\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*(?:\#[^\n]*\Z)?
    |{_PREFIX}(?:"{{3}}(?:[^"\\]|\\.|"(?!""))*"{{3}}|'{{3}}(?:[^'\\]|\\.|'(?!''))*'{{3}})
    |(?:[fF][rR]?|[rR][fF])(?:"(?:[^"\\{{}}\n]|\\.|\{{\{{|\}}\}}|{_FIELD})*"|'(?:[^'\\{{}}\n]|\\.|\{{\{{|\}}\}}|{_FIELD})*')
    |{_PREFIX}(?:(?!"{{3}})"(?:[^"\\\n]|\\.)*"|(?!'{{3}})'(?:[^'\\\n]|\\.)*')
    |[^\W\d]\w*
    |0[xXbBoO]\w*|(?:\d\w*(?:\.\w*)?|\.\d\w*)(?:(?<=[eE])[+-]\d\w*)?
    |\#[^\n]*|\\\n
    |\*\*=|//=|>>=|<<=|\.\.\.|:=|!=|->|\*\*|//|<<|>>|[-+*/%@&|^<>=]=
    |[^ \t\f]""",
    re.VERBOSE | re.DOTALL,
)
# The keywords of Python 3.
_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield"
).split()
_SOFT = ["match", "case", "type"]
_LONG = "**= //= >>= <<= ... := != -> ** // << >> -= += *= /= %= @= &= |= ^= <= >= ==".split()
_CODE = private(_KEYWORDS + _SOFT + _LONG, 0xE000)
_K = _CODE  # by text
_NAMES = frozenset(["n", *(_CODE[s] for s in _SOFT)])
_NUMBER = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+"
    r"|(?:[1-9](?:_?\d)*|0(?:_?0)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)[jJ]?|\d(?:_?\d)*[jJ])",
    re.ASCII,
)
_QUOTED = re.compile(r"""'[^']*'|"[^"]*\"""")
_ESCAPE = re.compile(r"\\(?:\\|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{(?P<name>[^}]+)\}|(?P<bad>[xuUN])|.)", re.DOTALL)
_BYTE_ESCAPE = re.compile(r"\\(?:\\|x[0-9a-fA-F]{2}|(x)|.)", re.DOTALL)


def _named(name: str | None) -> bool:
    """Whether a character of that name exists; also for none."""
    try:
        return name is None or bool(unicodedata.lookup(name))
    except KeyError:
        return False


def _classify(text: str) -> tuple[str, bool]:
    c = text[0]
    if "\n" in text[:1] or (c in " \t\f#" and "\n" in text):
        return "\n", False
    if c == "#" or text == "\\\n":
        return "", False
    if text[-1] in "\"'" and len(text) > 1:
        prefix = text[: min(i for i in (text.find('"'), text.find("'")) if i >= 0)].lower()
        if "b" in prefix:
            if not text.isascii() or ("r" not in prefix and any(m[1] for m in _BYTE_ESCAPE.finditer(text))):
                return BAD, False
            return "y", False
        if "r" not in prefix and "\\" in text and any(m["bad"] or not _named(m["name"]) for m in _ESCAPE.finditer(text)):
            return BAD, False
        if "f" in prefix and not _fields_parse(text[len(prefix):]):
            return BAD, False
        return "s", False
    if c.isdigit() or (c == "." and len(text) > 1):
        return ("0" if _NUMBER.fullmatch(text) else BAD), True
    if c == "_" or c.isalpha() or text.isidentifier():
        return ("n" if text.isidentifier() else BAD), True
    return (c if c in "+-*/%@&|^~<>=()[]{},:;." else BAD), True


_kinds = Kinds(_CODE, _classify)
_KIND = _kinds.__getitem__


def _fields_parse(quoted: str) -> bool:
    """Whether the replacement fields of a formatted string hold expressions."""
    q = 3 if quoted[:3] in ('"""', "'''") and len(quoted) >= 6 else 1
    body, i, start, depth = quoted[q:-q].replace("{{", "  ").replace("}}", "  ") if "{" in quoted and ":" not in quoted else quoted[q:-q], 0, -1, 0
    while i < len(body):
        c = body[i]
        if c == "{":
            if depth == 0 and body[i : i + 2] == "{{":
                i += 2
                continue
            if depth == 0:
                start = i + 1
            depth += 1
        elif c == "}":
            if depth == 0:
                if body[i : i + 2] == "}}":
                    i += 2
                    continue
                return False
            depth -= 1
            if depth == 0:
                field = body[start:i]
                level, cut = 0, len(field)
                for j, x in enumerate(_QUOTED.sub(lambda m: "_" * len(m[0]), field)):
                    if x in "([{":
                        level += 1
                    elif x in ")]}":
                        level -= 1
                    elif level == 0 and (x == ":" or (x == "!" and field[j + 1 : j + 2] != "=")):
                        cut = j
                        break
                expression = field[:cut].rstrip()
                if expression.endswith("=") and expression[-2:-1] not in ("=", "!", "<", ">"):
                    expression = expression[:-1]
                kinds = "".join(map(_KIND, _LEX.findall(expression.strip()))).replace("\n", "")
                try:
                    line = _Line(kinds)
                    line.star_list()
                    if line.k[line.i] != END:
                        return False
                except SyntaxFault:
                    return False
        i += 1
    return depth == 0


_BINARY = {
    _K["or"]: 1, _K["and"]: 2,
    **{c: 4 for c in "<>"}, **{_K[c]: 4 for c in ("==", "!=", "<=", ">=", "in", "is", "not")},
    "|": 5, "^": 6, "&": 7, _K["<<"]: 8, _K[">>"]: 8, "+": 9, "-": 9,
    "*": 10, "/": 10, "%": 10, "@": 10, _K["//"]: 10,
}
_AUGMENTED = frozenset(_K[c] for c in ("+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "**=", "//=", ">>=", "<<="))
_CONSTANT = frozenset([_K["None"], _K["True"], _K["False"], _K["..."], "0"])
_CLOSERS = frozenset([")", "]", "}", ":", END, "=", ";", ",", *_AUGMENTED])
# What an expression can be assigned as.
_PLAIN, _NAME, _PLACE, _SEVERAL, _STAR = 0, 1, 2, 3, 4


class _Line:
    """One logical line."""

    def __init__(self, kinds: str) -> None:
        self.k = kinds + END
        self.i = 0

    def fail(self, message: str = "invalid syntax") -> None:
        raise SyntaxFault(self.i, message)

    def need(self, kind: str, what: str) -> None:
        if self.k[self.i] != kind:
            self.fail(f"expected {what}")
        self.i += 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def name(self) -> None:
        if self.k[self.i] not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    # expressions

    def named(self) -> int:
        start = self.i
        if self.k[start] in _NAMES and self.k[start + 1] == _K[":="]:
            self.i += 2
            self.test()
            return _PLAIN
        return self.test()

    def test(self) -> int:
        if self.k[self.i] == _K["lambda"]:
            self.i += 1
            self.parameters(":", False)
            self.need(":", "':'")
            self.test()
            return _PLAIN
        kind = self.binary(1)
        if self.k[self.i] == _K["if"]:
            self.i += 1
            self.binary(1)
            self.need(_K["else"], "'else' after 'if' expression")
            self.test()
            return _PLAIN
        return kind

    def binary(self, least: int) -> int:
        c = self.k[self.i]
        if c == _K["not"]:
            if least > 3:
                self.fail()
            self.i += 1
            self.binary(3)
            kind = _PLAIN
        else:
            kind = self.unary()
        while True:
            c = self.k[self.i]
            level = _BINARY.get(c)
            if level is None or level < least:
                return kind
            self.i += 1
            if c == _K["not"]:
                self.need(_K["in"], "'in'")
            elif c == _K["is"] and self.k[self.i] == _K["not"]:
                self.i += 1
            self.binary(level + 1)
            kind = _PLAIN

    def unary(self) -> int:
        c = self.k[self.i]
        if c in "+-~":
            self.i += 1
            self.unary()
            return _PLAIN
        if c == _K["await"]:
            self.i += 1
            self.primary()
            kind = _PLAIN
        else:
            kind = self.primary()
        if self.k[self.i] == _K["**"]:
            self.i += 1
            self.unary()
            return _PLAIN
        return kind

    def primary(self) -> int:
        k = self.k
        c = k[self.i]
        if c in _NAMES:
            self.i += 1
            kind = _NAME
        elif c in _CONSTANT:
            self.i += 1
            kind = _PLAIN
        elif c == "s" or c == "y":
            self.i += 1
            while k[self.i] in "sy":
                if k[self.i] != c:
                    self.fail("cannot mix bytes and nonbytes literals")
                self.i += 1
            kind = _PLAIN
        elif c == "(":
            kind = self.parenthesis()
        elif c == "[":
            kind = self.bracket()
        elif c == "{":
            self.brace()
            kind = _PLAIN
        else:
            self.fail()
        while True:
            c = k[self.i]
            if c == ".":
                self.i += 1
                self.name()
                kind = _PLACE
            elif c == "(":
                self.arguments()
                kind = _PLAIN
            elif c == "[":
                self.i += 1
                self.subscripts()
                kind = _PLACE
            else:
                return kind

    def comprehension(self) -> bool:
        found = False
        while self.k[self.i] == _K["for"] or (self.k[self.i] == _K["async"] and self.k[self.i + 1] == _K["for"]):
            found = True
            self.i += 1 if self.k[self.i] == _K["for"] else 2
            self.targets()
            self.need(_K["in"], "'in'")
            self.binary(1)
            while self.k[self.i] == _K["if"]:
                self.i += 1
                start = self.i
                if self.k[start] in _NAMES and self.k[start + 1] == _K[":="]:
                    self.fail()
                if self.k[self.i] == _K["lambda"]:
                    self.test()
                else:
                    self.binary(1)
        return found

    def targets(self) -> None:
        """Targets of a for: a list of starred or plain places."""
        while True:
            self.take("*")
            if self.unary_target() == _PLAIN:
                self.fail("cannot assign to expression")
            if not self.take(",") or self.k[self.i] == _K["in"]:
                return

    def unary_target(self) -> int:
        return self.primary()

    def starred(self) -> int:
        if self.k[self.i] == "*":
            self.i += 1
            kind = self.binary(5)
            return _STAR if kind != _PLAIN else _STAR + 1
        return self.named()

    def items(self, close: str) -> tuple[int, bool, int]:
        """Up to ``close``: what all can be assigned as, whether a comma occurred, kind of the first."""
        assignable, comma, first, n = True, False, _PLAIN, 0
        while self.k[self.i] != close:
            kind = self.starred()
            n += 1
            first = kind if n == 1 else first
            if kind in (_PLAIN, _STAR + 1):
                assignable = False
            if n == 1 and self.comprehension():
                if kind >= _STAR:
                    self.fail("iterable unpacking cannot be used in comprehension")
                self.need(close, f"'{close}'")
                return _PLAIN, True, _PLAIN
            if self.k[self.i] == ",":
                comma = True
                self.i += 1
            elif self.k[self.i] != close:
                self.fail("invalid syntax. Perhaps you forgot a comma?")
        self.i += 1
        return (_SEVERAL if assignable else _PLAIN), comma or n == 0, first

    def parenthesis(self) -> int:
        self.i += 1
        if self.k[self.i] == _K["yield"]:
            self.yields()
            self.need(")", "')'")
            return _PLAIN
        several, comma, first = self.items(")")
        if comma:
            return several
        if first >= _STAR:
            self.fail("cannot use starred expression here")
        return first

    def bracket(self) -> int:
        self.i += 1
        return self.items("]")[0]

    def brace(self) -> None:
        self.i += 1
        k = self.k
        n, mapping = 0, None
        while k[self.i] != "}":
            if k[self.i] == _K["**"]:
                self.i += 1
                self.binary(5)
                is_map = True
                if mapping is False:
                    self.fail()
            else:
                self.starred()
                is_map = k[self.i] == ":"
                if mapping is not None and is_map != mapping:
                    self.fail("':' expected after dictionary key" if mapping else "invalid syntax")
                if is_map:
                    self.i += 1
                    self.test()
            mapping = is_map
            n += 1
            if n == 1 and self.comprehension():
                break
            if not self.take(",") and k[self.i] != "}":
                self.fail("invalid syntax. Perhaps you forgot a comma?")
        self.need("}", "'}'")

    def arguments(self) -> None:
        self.i += 1
        k = self.k
        keyword = unpacked = False
        n = 0
        while k[self.i] != ")":
            c = k[self.i]
            if c == "*":
                if unpacked:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
                self.i += 1
                self.test()
            elif c == _K["**"]:
                self.i += 1
                self.test()
                unpacked = True
            elif c in _NAMES and k[self.i + 1] == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                if keyword or unpacked:
                    self.fail("positional argument follows keyword argument")
                self.named()
                if self.comprehension():
                    if n or k[self.i] == ",":
                        self.fail("Generator expression must be parenthesized")
            n += 1
            if not self.take(",") and k[self.i] != ")":
                self.fail("invalid syntax. Perhaps you forgot a comma?")
        self.i += 1

    def subscripts(self) -> None:
        if self.k[self.i] == "]":
            self.fail()
        while self.k[self.i] != "]":
            if self.k[self.i] == "*":
                self.i += 1
                self.binary(5)
            else:
                if self.k[self.i] != ":":
                    self.named()
                if self.k[self.i] == ":":
                    self.i += 1
                    if self.k[self.i] not in "],:":
                        self.test()
                    if self.take(":") and self.k[self.i] not in "],":
                        self.test()
            if not self.take(",") and self.k[self.i] != "]":
                self.fail("invalid syntax. Perhaps you forgot a comma?")
        self.i += 1

    def star_list(self) -> int:
        """Expressions with commas; what they can be assigned as."""
        kind = self.starred()
        if self.k[self.i] != ",":
            if kind == _STAR + 1 or kind == _STAR:
                return kind
            return kind
        assignable = kind not in (_PLAIN, _STAR + 1)
        while self.take(","):
            if self.k[self.i] in _CLOSERS or self.k[self.i] == _K["in"]:
                break
            kind = self.starred()
            assignable = assignable and kind not in (_PLAIN, _STAR + 1)
        return _SEVERAL if assignable else _PLAIN

    def yields(self) -> None:
        self.i += 1
        if self.take(_K["from"]):
            self.test()
        elif self.k[self.i] not in _CLOSERS:
            self.star_list()

    # statements

    def parameters(self, close: str, annotated: bool) -> None:
        """Of a def or lambda, up to but without ``close``."""
        k = self.k
        default = star = slash = ended = bare = False
        while k[self.i] != close:
            if ended:
                self.fail("arguments cannot follow var-keyword argument")
            c = k[self.i]
            if c == "/":
                if slash or star or k[self.i - 1] in "(:" or k[self.i - 1] == _K["lambda"]:
                    self.fail("/ must be ahead of *")
                slash = True
                self.i += 1
            elif c == "*":
                if star:
                    self.fail("* argument may appear only once")
                star = True
                self.i += 1
                if k[self.i] in _NAMES:
                    self.i += 1
                    if annotated and self.take(":"):
                        self.starred()
                else:
                    bare = True
                    if k[self.i] != "," or k[self.i + 1] in (close, _K["**"]):
                        self.fail("named arguments must follow bare *")
            elif c == _K["**"]:
                self.i += 1
                self.name()
                if annotated and self.take(":"):
                    self.test()
                ended = True
            else:
                self.name()
                if annotated and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.take(",") and k[self.i] != close:
                self.fail()
        del bare

    def type_parameters(self) -> None:
        if self.take("["):
            while self.k[self.i] != "]":
                if not self.take("*"):
                    self.take(_K["**"])
                self.name()
                if self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                if not self.take(",") and self.k[self.i] != "]":
                    self.fail()
            self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def simple(self) -> None:
        """Simple statements up to the end of the line."""
        while True:
            self.small()
            if self.take(";"):
                if self.k[self.i] == END:
                    return
            elif self.k[self.i] == END:
                return
            else:
                self.fail()

    def small(self) -> None:
        k = self.k
        c = k[self.i]
        handler = _SMALL.get(c)
        if handler is not None:
            self.i += 1
            handler(self)
            return
        if c == _K["type"] and k[self.i + 1] in _NAMES and k[self.i + 2] in "=[":
            self.i += 1
            self.name()
            self.type_parameters()
            self.need("=", "'='")
            self.test()
            return
        start = self.i
        if c == _K["yield"]:
            self.yields()
            kind = _PLAIN
        else:
            kind = self.star_list()
        c = k[self.i]
        if c == ":":
            if kind not in (_NAME, _PLACE):
                self.fail("illegal target for annotation")
            self.i += 1
            self.test()
            if self.take("="):
                if k[self.i] == _K["yield"]:
                    self.yields()
                else:
                    self.star_list()
            return
        if c in _AUGMENTED:
            if kind not in (_NAME, _PLACE):
                self.fail("illegal expression for augmented assignment")
            self.i += 1
            if k[self.i] == _K["yield"]:
                self.yields()
            else:
                self.star_list()
            return
        while k[self.i] == "=":
            if kind in (_PLAIN, _STAR, _STAR + 1):
                raise SyntaxFault(start, "cannot assign to expression")
            self.i += 1
            start = self.i
            if k[self.i] == _K["yield"]:
                self.yields()
                kind = _PLAIN
            else:
                kind = self.star_list()

    def _nothing(self) -> None:
        pass

    def _return(self) -> None:
        if self.k[self.i] not in (END, ";"):
            self.star_list()

    def _raise(self) -> None:
        if self.k[self.i] not in (END, ";"):
            self.test()
            if self.take(_K["from"]):
                self.test()

    def _names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def _del(self) -> None:
        while True:
            if self.primary() == _PLAIN:
                self.fail("cannot delete expression")
            if not self.take(",") or self.k[self.i] in (END, ";"):
                return

    def _assert(self) -> None:
        self.test()
        if self.take(","):
            self.test()

    def _import(self) -> None:
        while True:
            self.dotted()
            if self.take(_K["as"]):
                self.name()
            if not self.take(","):
                return

    def _from(self) -> None:
        dots = False
        while self.k[self.i] == "." or self.k[self.i] == _K["..."]:
            dots = True
            self.i += 1
        if not (dots and self.k[self.i] == _K["import"]):
            self.dotted()
        self.need(_K["import"], "'import'")
        if self.take("*"):
            return
        inside = self.take("(")
        while True:
            self.name()
            if self.take(_K["as"]):
                self.name()
            if not self.take(","):
                break
            if self.k[self.i] == ")" and inside:
                break
            if self.k[self.i] == END:
                self.fail("trailing comma not allowed without surrounding parentheses")
        if inside:
            self.need(")", "')'")

    def suite(self, word: str) -> tuple[str, bool]:
        self.need(":", "':'")
        if self.k[self.i] == END:
            return word, True
        if self.k[self.i] in _COMPOUND:
            self.fail()
        self.simple()
        return word, False

    def pattern(self) -> None:
        """Patterns of a case, in the shapes of expressions: names, values, sequences, mappings, classes."""
        self.pattern_one()
        while self.take(","):
            if self.k[self.i] in (":", _K["if"]):
                return
            self.pattern_one()

    def pattern_one(self) -> None:
        k = self.k
        if self.take("*"):
            self.name()
            return
        while True:
            c = k[self.i]
            if c in "([":
                close = ")" if c == "(" else "]"
                self.i += 1
                while k[self.i] != close:
                    self.pattern_one()
                    if not self.take(",") and k[self.i] != close:
                        self.fail()
                self.i += 1
            elif c == "{":
                self.i += 1
                while k[self.i] != "}":
                    if self.take(_K["**"]):
                        self.name()
                    else:
                        self.binary(5)
                        self.need(":", "':'")
                        self.pattern_one()
                    if not self.take(",") and k[self.i] != "}":
                        self.fail()
                self.i += 1
            elif c in _NAMES:
                self.dotted()
                if self.take("("):
                    while k[self.i] != ")":
                        if k[self.i] in _NAMES and k[self.i + 1] == "=":
                            self.i += 2
                        self.pattern_one()
                        if not self.take(",") and k[self.i] != ")":
                            self.fail()
                    self.i += 1
            else:
                self.binary(6)
            if not self.take("|"):
                break
        if self.take(_K["as"]):
            self.name()

    def statement(self) -> tuple[str, bool]:
        """The word that opens the statement ('' for simple ones) and whether a block must follow."""
        k = self.k
        c = k[0]
        word = _COMPOUND.get(c)
        if word is None:
            if c == "@":
                self.i = 1
                self.named()
                if k[self.i] != END:
                    self.fail()
                return "@", False
            if c == _K["match"] or c == _K["case"]:
                word = "match" if c == _K["match"] else "case"
                try:
                    self.i = 1
                    if word == "match":
                        self.star_list()
                    else:
                        self.pattern()
                        if self.take(_K["if"]):
                            self.named()
                    if word == "match":
                        self.need(":", "':'")
                        if k[self.i] != END:
                            self.fail()
                        return word, True
                    return self.suite(word)
                except SyntaxFault as fault:
                    self.i = 0
                    try:
                        self.simple()
                    except SyntaxFault:
                        raise fault from None
                    return "", False
            self.simple()
            return "", False
        self.i = 1
        if word == "async":
            word = _COMPOUND.get(k[1], "")
            if word not in ("def", "for", "with"):
                self.fail()
            self.i = 2
        if word in ("if", "elif", "while"):
            self.named()
        elif word == "for":
            self.targets()
            self.need(_K["in"], "'in'")
            self.star_list()
        elif word == "def":
            self.name()
            self.type_parameters()
            self.need("(", "'('")
            self.parameters(")", True)
            self.need(")", "')'")
            if self.take(_K["->"]):
                self.star_list()
        elif word == "class":
            self.name()
            self.type_parameters()
            if k[self.i] == "(":
                self.arguments()
        elif word == "with":
            self.with_items()
        elif word == "except":
            self.take("*")
            if k[self.i] != ":":
                self.test()
                if k[self.i] == ",":
                    self.fail("multiple exception types must be parenthesized")
                if self.take(_K["as"]):
                    self.name()
        return self.suite(word)

    def with_items(self) -> None:
        k = self.k
        if k[self.i] == "(":
            start = self.i
            try:  # items in parentheses
                self.i += 1
                while k[self.i] != ")":
                    self.test()
                    if self.take(_K["as"]) and self.unary_target() == _PLAIN:
                        self.fail("cannot assign to expression")
                    if not self.take(",") and k[self.i] != ")":
                        self.fail()
                self.i += 1
                if k[self.i] == ":":
                    return
            except SyntaxFault:
                pass
            self.i = start
        while True:
            self.test()
            if self.take(_K["as"]):
                self.take("*")
                if self.unary_target() == _PLAIN:
                    self.fail("cannot assign to expression")
            if not self.take(","):
                return


_SMALL = {
    _K["pass"]: _Line._nothing, _K["break"]: _Line._nothing, _K["continue"]: _Line._nothing, _K["return"]: _Line._return, _K["raise"]: _Line._raise,
    _K["global"]: _Line._names, _K["nonlocal"]: _Line._names, _K["del"]: _Line._del, _K["assert"]: _Line._assert, _K["import"]: _Line._import, _K["from"]: _Line._from,
}
_COMPOUND = {_K[w]: w for w in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async")}

_verdicts: dict[str, tuple[str, bool]] = {}
_balance: dict[str, int | None] = {}
_indents: dict[str, tuple[int, int]] = {}
# What the language's tokenizer bears.
BRACKETS = 200
INDENTS = 100


def _deepest(piece: str) -> int:
    """Most brackets that are open at once."""
    depth = most = 0
    for c in piece:
        if c in "([{":
            depth += 1
            most = max(most, depth)
        elif c in ")]}":
            depth -= 1
    return most




def _measure(piece: str) -> int | None:
    """Brackets that a physical line leaves open; None where it closes more than it opens."""
    depth = least = 0
    for c in piece:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            least = min(least, depth)
    value = depth if least == 0 else None
    if len(piece) <= 160:
        if len(_balance) > 200_000:
            _balance.clear()
        _balance[piece] = value
    return value


def _indent(token: str) -> tuple[int, int]:
    column = other = 0
    for c in token[token.rfind("\n") + 1 :].rpartition("#")[0] or token[token.rfind("\n") + 1 :]:
        if c == " ":
            column += 1
            other += 1
        elif c == "\t":
            column = (column // 8 + 1) * 8
            other += 1
        elif c == "\f":
            column = other = 0
        else:
            break
    if len(_indents) > 50_000:
        _indents.clear()
    _indents[token] = column, other
    return column, other


_COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)")


def decode(source: bytes) -> tuple[str, str]:
    """The text, or why it cannot be read, as (text, '') or ('', reason)."""
    if source[:3] == codecs.BOM_UTF8:
        source, name = source[3:], "utf-8"
    else:
        name = "utf-8"
    for line in source.split(b"\n", 2)[:2]:
        found = _COOKIE.match(line)
        if found:
            name = found[1].decode("ascii")
            break
        if line.strip() and not line.lstrip(b" \t\f").startswith(b"#"):
            break
    if b"\0" in source:
        return "", "source code cannot contain null bytes"
    try:
        return source.decode(name), ""
    except (UnicodeDecodeError, LookupError) as fault:
        return "", f"{type(fault).__name__}: {fault}"[:120]


def check(source: bytes) -> list[tuple[int, str]]:
    """Syntax errors as (line, message), by line; empty for a source that parses."""
    text, reason = decode(source)
    if reason:
        return [(1, reason)]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    tokens = _LEX.findall("\n" + text)
    pieces = "".join(map(_KIND, tokens)).split("\n")
    breaks = [t for t in tokens if "\n" in t and t[0] in "\n \t\f#"]
    allow(len(tokens))
    errors: list[tuple[int, str]] = []  # (piece, message)
    stack = [[0, 0, "", ""]]  # column, the column with tabs as one, last clause at this level, word of the header
    opened = ""
    i, n = 1, len(pieces)
    while i < n:
        piece = pieces[i]
        if not piece:
            i += 1
            continue
        first = i
        depth = _balance[piece] if piece in _balance else _measure(piece)
        i += 1
        if depth:
            parts = [piece]
            while depth and i < n:
                more = pieces[i]
                step = _balance[more] if more in _balance else _measure(more)
                if step is None:
                    step = more.count("(") + more.count("[") + more.count("{") - more.count(")") - more.count("]") - more.count("}")
                depth += step
                parts.append(more)
                i += 1
                if depth < 0:
                    break
            if depth:
                errors.append((first, "bracket was never closed" if depth > 0 else "unmatched bracket"))
                i = first + 1
                piece = ""
            else:
                piece = "".join(parts)
        token = breaks[first - 1]
        column, other = _indents[token] if token in _indents else _indent(token)
        top = stack[-1]
        if column > top[0]:
            if not opened:
                errors.append((first, "unexpected indent"))
            elif other <= top[1]:
                errors.append((first, "inconsistent use of tabs and spaces in indentation"))
            stack.append([column, other, "", opened])
            top = stack[-1]
            if len(stack) > INDENTS:
                errors.append((first, "too many levels of indentation"))
                break
        else:
            if opened:
                errors.append((first, f"expected an indented block after '{opened}'"))
            while column < top[0] and len(stack) > 1:
                if top[2] in ("try", "@"):
                    errors.append((first, "expected 'except' or 'finally' block" if top[2] == "try" else "expected a definition after a decorator"))
                stack.pop()
                top = stack[-1]
            if column != top[0]:
                errors.append((first, "unindent does not match any outer indentation level"))
                stack.append([column, other, "", ""])
                top = stack[-1]
            elif other != top[1]:
                errors.append((first, "inconsistent use of tabs and spaces in indentation"))
        opened = ""
        if not piece:
            continue
        verdict = _verdicts.get(piece)
        if verdict is None:
            try:
                if len(piece) > BRACKETS and _deepest(piece) > BRACKETS:
                    raise SyntaxFault(0, "too many nested parentheses")
                verdict = _Line(piece).statement()
                if len(piece) <= 160:
                    if len(_verdicts) > 200_000:
                        _verdicts.clear()
                    _verdicts[piece] = verdict
            except SyntaxFault as fault:
                errors.append((first, fault.message))
                # panic mode: the rest of the line is skipped, its block still opens
                word = _COMPOUND.get(piece[0], "")
                top[2] = word if word in ("if", "for", "while", "try", "except") else ""
                opened = (word or "?") if piece.endswith(":") else ""
                continue
            except RecursionError:
                errors.append((first, "too many nested parentheses"))
                continue
        word, block = verdict
        last = top[2]
        if word in _CLAUSES:
            if last not in _CLAUSES[word]:
                errors.append((first, f"'{word}' without its statement"))
            top[2] = "try-else" if word == "else" and last == "except" else word
        else:
            if last == "try":
                errors.append((first, "expected 'except' or 'finally' block"))
            elif last == "@" and word not in ("@", "def", "class"):
                errors.append((first, "expected a definition after a decorator"))
            if top[3] == "match" and word != "case":
                errors.append((first, "expected 'case'"))
            elif word == "case" and top[3] != "match":
                errors.append((first, "'case' outside 'match'"))
            top[2] = word if word in ("if", "for", "while", "try", "@") else ""
        if block:
            opened = word
    if opened:
        errors.append((n - 1, f"expected an indented block after '{opened}'"))
    for level in stack:
        if level[2] in ("try", "@"):
            errors.append((n - 1, "expected 'except' or 'finally' block" if level[2] == "try" else "expected a definition after a decorator"))
    if not errors:
        return []
    lines = [0]
    for token in tokens:  # line of each piece
        if "\n" in token and token[0] in "\n \t\f#":
            lines.append(lines[-1] + token.count("\n"))
        else:
            lines[-1] += 0
    return sorted((lines[min(at, len(lines) - 1)], message) for at, message in errors)


_CLAUSES = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "try-else")}
