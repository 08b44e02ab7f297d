"""JavaScript, script or module: recursive-descent statements, precedence-climbing expressions, panic-mode recovery."""

from __future__ import annotations

import re

from corpusmill.parsers.base import BAD, END, Descent, Kinds, Shapes, SyntaxFault, allow, private

_ID = r"(?:[$\w]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_COMMENT = r"/\*.*?\*/|//[^\n\r\u2028\u2029]*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*\})*`"
_TOKENS = (
    r"\"(?:[^\"\\\n\r]|\\\r\n|\\.)*\"|'(?:[^'\\\n\r]|\\\r\n|\\.)*'"
    rf"|0[xXbBoO]\w*|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?{_ID}*"
    rf"|\#?{_ID}+"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
)
_LEX = re.compile(rf"{_COMMENT}|{_TEMPLATE}|{_TOKENS}|[^\s\ufeff]", re.DOTALL)
_STEP = re.compile(rf"{_COMMENT}|{_TOKENS}|[^\s\ufeff]", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
#: Where a line break makes an error of what would parse without it.
_LINE_MATTERS = re.compile(r"\bthrow\s*[\n\r]|[\n\r]\s*=>")
# The reserved words, and the words that are reserved in some places.
_RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in "
    "instanceof new return super switch this throw try typeof var void while with null true false"
).split()
_CONTEXTUAL = "let static async await yield of get set as from".split()
_LONG = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> **"
).split()
_K = private(_RESERVED + _CONTEXTUAL + _LONG, 0xE000)
_NAMES = frozenset(["n", *(_K[w] for w in _CONTEXTUAL)])
_WORDS = _NAMES | frozenset(_K[w] for w in _RESERVED)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|0[0-9]+|(?:\d[\d_]*)n|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?")
_SINGLE = frozenset("+-*/%&|^~!<>=()[]{},:;.?@")
_BAD_ESCAPE = re.compile(r"\\(?:\\|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|([xu])|.)", re.DOTALL)


def _classify(text: str) -> tuple[str, bool]:
    c = text[0]
    if c == "/" and len(text) > 1 and text[1] in "/*":
        return "", False
    if c in "\"'" and len(text) > 1:
        return (BAD if "\\" in text and any(m[1] for m in _BAD_ESCAPE.finditer(text)) else "s"), False
    if c == "`" and len(text) > 1:
        return ("t" if "${" not in text or all(_expression_parses(x) for x in re.findall(r"(?<!\\)\$\{([^{}`]*)\}", text)) else BAD), False
    if c == "/" and len(text) > 1:
        return "r", False
    if c.isdigit() or (c == "." and len(text) > 1 and text[1].isdigit()):
        return ("0" if _NUMBER.fullmatch(text) else BAD), True
    if c == "#" and len(text) > 1:
        return "#", True
    if c in "$_\\" or c.isalnum():
        name = text.replace("$", "_")
        return ("n" if "\\" in name or name.isidentifier() or name.replace("\u200c", "").replace("\u200d", "").isidentifier() else BAD), True
    return (c if c in _SINGLE else BAD), True


_kinds = Kinds(_K, _classify)
_KIND = _kinds.__getitem__
_AFTER_VALUE = frozenset(["n", "0", "s", "t", "r", "#", ")", "]", "}", *(_K[w] for w in ("this", "super", "null", "true", "false", "++", "--", *_CONTEXTUAL))])


def _expression_parses(text: str) -> bool:
    parser = _parser(text, False)
    try:
        parser.expression()
        return parser.k[parser.i] == END
    except (SyntaxFault, RecursionError):
        return False


def _lex_slowly(text: str) -> tuple[str, list[bool], list[int]]:
    """Kinds, whether a line break stands before each token, and where each begins; tells regular
    expressions from divisions by the token before them, and follows nested templates."""
    kinds: list[str] = []
    breaks: list[bool] = []
    starts: list[int] = []
    at, n, newline, last = 0, len(text), False, ""
    line_break = re.compile(r"[\n\r\u2028\u2029]")
    while at < n:
        c = text[at]
        if c == "/" and last not in _AFTER_VALUE and (found := _REGEX.match(text, at)):
            flags = found[0][found[0].rfind("/") + 1 :]
            kind, end = ("r" if len(set(flags)) == len(flags) and set(flags) <= set("dgimsuvy") else BAD), found.end()
        elif c == "`":
            end = _template_end(text, at)
            kind = "t" if end > 0 else BAD
            end = end if end > 0 else at + 1
        else:
            found = _STEP.match(text, at)
            if not found:
                newline = newline or bool(line_break.match(c))
                at += 1
                continue
            token, end = found[0], found.end()
            kind = _KIND(token)
            if not kind:
                newline = newline or bool(line_break.search(token))
                at = end
                continue
        kinds.append(kind)
        breaks.append(newline)
        starts.append(at)
        newline, last, at = False, kind, end
    return "".join(kinds), breaks, starts


def _template_end(text: str, at: int) -> int:
    """Behind the template that begins at ``at``; 0 if it does not end or a substitution does not parse."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            start, depth, i = i + 2, 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template_end(text, i)
                    if not i:
                        return 0
                    continue
                if c in "\"'" or text[i : i + 2] in ("/*", "//"):
                    found = _STEP.match(text, i)
                    i = max(found.end(), i + 1)
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
            if depth or not _expression_parses(text[start : i - 1]):
                return 0
        else:
            i += 1
    return 0


def _levels(table: list[str]) -> dict[str, int]:
    return {_K.get(c, c): level for level, row in enumerate(table, 1) for c in row.split()}


_BINARY = _levels(["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"])
_POWER = _BINARY[_K["**"]]
_ASSIGN = frozenset(["=", *(_K[c] for c in (">>>=", "**=", "<<=", ">>=", "&&=", "||=", "??=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="))])
_UNARY = frozenset(["+", "-", "~", "!", *(_K[w] for w in ("delete", "void", "typeof"))])
_ENDS = frozenset([")", "]", "}", ",", ";", ":", END, _K["in"], _K["of"]])
_VALUES = frozenset(["0", "s", "t", "r", *(_K[w] for w in ("this", "null", "true", "false"))])
# What an expression can be assigned as: not at all, a place, a pattern.
_PLAIN, _PLACE, _PATTERN = 0, 1, 2
_simple, _heads, _for_heads, _parameter_heads = Shapes(), Shapes(), Shapes(), Shapes()
_JUMPS = frozenset(_K[w] for w in ("return", "break", "continue", "await", "yield", "super", "new"))


class _Parser(Descent):
    def __init__(self, kinds: str, breaks: list[bool] | None) -> None:
        super().__init__(kinds)
        self.breaks = breaks
        self.functions = self.loops = self.switches = 0
        self.generator = self.async_ = False
        self.no_in = False

    def broken(self) -> bool:
        """Whether a line break stands before the current token; False where that is not known."""
        return bool(self.breaks) and self.i < len(self.breaks) and self.breaks[self.i]

    def end(self) -> None:
        """End of a statement, with automatic semicolons."""
        c = self.k[self.i]
        if c == ";":
            self.i += 1
        elif c != "}" and c != END and not self.broken():
            self.fail("unexpected token")

    # statements

    def program(self) -> None:
        while self.k[self.i] != END:
            if self.k[self.i] == "}":
                self.errors.append((self.i, "unexpected }"))
                self.i += 1
                continue
            self.guarded()

    def guarded(self) -> None:
        start = self.i
        try:
            self.statement()
        except SyntaxFault as fault:
            self.panic(fault, start)

    def block(self) -> None:
        self.need("{")
        while True:
            c = self.k[self.i]
            if c == "}":
                self.i += 1
                return
            if c == END:
                self.fail("unexpected end of input")
            self.guarded()

    def statement(self) -> None:
        k, start = self.k, self.i
        c = k[start]
        handler = _STATEMENTS.get(c)
        if c not in _JUMPS and (handler is None or handler is _Parser.declaration):
            stop = k.find(";", start) + 1
            if 0 < stop - start <= 160 and k[start:stop] in _simple:
                self.i = stop
                return
        else:
            stop = 0
        if handler is not None:
            handler(self)
        elif c == _K["async"] and k[start + 1] == _K["function"]:
            self.i += 1
            self.function(True)
            return
        elif c == _K["let"] and (k[start + 1] in _NAMES or k[start + 1] in "[{"):
            self.declaration()
        elif c in _NAMES and k[start + 1] == ":":
            self.i += 2
            self.statement()
            return
        else:
            self.expression()
            self.end()
        if stop and self.i == stop and not any(x in k[start:stop] for x in "{}") and not any(x in k[start:stop] for x in _JUMPS):
            _simple.learn(k[start:stop])

    def head(self) -> None:
        """A parenthesised condition."""
        start = self.i
        stop = self.k.find("{", start)
        if stop > 0 and self.k[start:stop] in _heads:
            self.i = stop
            return
        self.need("(")
        self.expression()
        self.need(")")
        if self.i == stop and not any(x in self.k[start:stop] for x in _JUMPS):
            _heads.learn(self.k[start:stop])

    def declaration(self) -> None:
        constant = self.k[self.i] == _K["const"]
        self.i += 1
        self.bindings(constant, False)
        self.end()

    def bindings(self, constant: bool, head: bool) -> None:
        while True:
            pattern = self.k[self.i] in "[{"
            self.binding()
            if self.k[self.i] == "=":
                self.i += 1
                self.assign()
            elif (pattern or constant) and not (head and (self.k[self.i] == _K["in"] or self.k[self.i] == _K["of"])):
                self.fail("missing initializer")
            if self.k[self.i] != ",":
                return
            self.i += 1

    def binding(self) -> None:
        c = self.k[self.i]
        if c in _NAMES:
            self.i += 1
        elif c == "[":
            self.i += 1
            while self.k[self.i] != "]":
                if self.k[self.i] == ",":
                    self.i += 1
                    continue
                rest = self.k[self.i] == _K["..."]
                self.i += rest
                self.binding_default()
                if self.k[self.i] == "," and not rest:
                    self.i += 1
                elif self.k[self.i] != "]":
                    self.fail("unexpected token in pattern")
            self.i += 1
        elif c == "{":
            self.i += 1
            while self.k[self.i] != "}":
                if self.k[self.i] == _K["..."]:
                    self.i += 1
                    self.binding()
                else:
                    short = self.k[self.i] in _NAMES
                    self.property_name()
                    if self.k[self.i] == ":":
                        self.i += 1
                        self.binding_default()
                    elif not short:
                        self.fail("unexpected token in pattern")
                    elif self.k[self.i] == "=":
                        self.i += 1
                        self.assign()
                if self.k[self.i] == ",":
                    self.i += 1
                elif self.k[self.i] != "}":
                    self.fail("unexpected token in pattern")
            self.i += 1
        else:
            self.fail("expected a name")

    def binding_default(self) -> None:
        self.binding()
        if self.k[self.i] == "=":
            self.i += 1
            self.assign()

    def if_(self) -> None:
        self.i += 1
        self.head()
        self.statement()
        if self.k[self.i] == _K["else"]:
            self.i += 1
            self.statement()

    def loop_body(self) -> None:
        self.loops += 1
        try:
            self.statement()
        finally:
            self.loops -= 1

    def for_(self) -> None:
        k = self.k
        self.i += 1
        if k[self.i] == _K["await"]:
            self.i += 1
        start = self.i
        stop = k.find("{", start)
        if stop > 0 and k[start:stop] in _for_heads:
            self.i = stop
            return self.loop_body()
        self.need("(")
        self.no_in = True
        try:
            c = k[self.i]
            if c == ";":
                kind = _PLAIN
            elif c == _K["var"] or c == _K["const"] or (c == _K["let"] and (k[self.i + 1] in _NAMES or k[self.i + 1] in "[{")):
                self.i += 1
                self.bindings(c == _K["const"], True)
                kind = _PATTERN
            else:
                kind = self.expression()
        finally:
            self.no_in = False
        if k[self.i] == _K["of"] or k[self.i] == _K["in"]:
            if kind == _PLAIN:
                self.fail("invalid left-hand side in for")
            of = k[self.i] == _K["of"]
            self.i += 1
            if of:
                self.assign()
            else:
                self.expression()
        else:
            self.need(";")
            if k[self.i] != ";":
                self.expression()
            self.need(";")
            if k[self.i] != ")":
                self.expression()
        self.need(")")
        if self.i == stop and not any(x in k[start:stop] for x in _JUMPS):
            _for_heads.learn(k[start:stop])
        self.loop_body()

    def while_(self) -> None:
        self.i += 1
        self.head()
        self.loop_body()

    def do(self) -> None:
        self.i += 1
        self.loop_body()
        self.need(_K["while"], "while")
        self.need("(")
        self.expression()
        self.need(")")
        if self.k[self.i] == ";":
            self.i += 1

    def jump(self) -> None:
        word = self.k[self.i]
        self.i += 1
        label = self.k[self.i] in _NAMES and not self.broken()
        if label:
            self.i += 1
        elif not self.loops and not (word == _K["break"] and self.switches):
            self.fail("illegal break or continue", self.i - 1)
        self.end()

    def return_(self) -> None:
        if not self.functions:
            self.fail("illegal return")
        self.i += 1
        c = self.k[self.i]
        if c != ";" and c != "}" and c != END and not self.broken():
            self.expression()
        self.end()

    def throw(self) -> None:
        self.i += 1
        if self.broken():
            self.fail("line break after throw")
        self.expression()
        self.end()

    def try_(self) -> None:
        self.i += 1
        self.block()
        found = False
        if self.k[self.i] == _K["catch"]:
            found = True
            self.i += 1
            if self.k[self.i] == "(":
                self.i += 1
                self.binding()
                self.need(")")
            self.block()
        if self.k[self.i] == _K["finally"]:
            found = True
            self.i += 1
            self.block()
        if not found:
            self.fail("missing catch or finally after try")

    def switch(self) -> None:
        self.i += 1
        self.head()
        self.need("{")
        self.switches += 1
        default = False
        while self.k[self.i] != "}":
            if self.k[self.i] == _K["default"]:
                if default:
                    self.fail("more than one default")
                default = True
                self.i += 1
            else:
                self.need(_K["case"], "case")
                self.expression()
            self.need(":")
            while self.k[self.i] not in (_K["case"], _K["default"], "}"):
                if self.k[self.i] == END:
                    self.fail("unexpected end of input")
                self.guarded()
        self.switches -= 1
        self.i += 1

    def with_(self) -> None:
        self.i += 1
        self.head()
        self.statement()

    def word(self) -> None:
        self.i += 1
        self.end()

    def nothing(self) -> None:
        self.i += 1

    def import_(self) -> None:
        k = self.k
        if k[self.i + 1] in "(.":
            self.expression()
            return self.end()
        self.i += 1
        if k[self.i] == "s":
            self.i += 1
            return self.attributes()
        if k[self.i] in _NAMES:
            self.i += 1
            if k[self.i] == ",":
                self.i += 1
                if k[self.i] not in "*{":
                    self.fail("unexpected token in import")
        if k[self.i] == "*":
            self.i += 1
            self.need(_K["as"], "as")
            self.name()
        elif k[self.i] == "{":
            self.specifiers()
        self.need(_K["from"], "from")
        self.need("s", "a module name")
        self.attributes()

    def attributes(self) -> None:
        if self.k[self.i] == _K["with"]:
            self.i += 1
            self.object()
        self.end()

    def specifiers(self) -> None:
        self.i += 1
        while self.k[self.i] != "}":
            if self.k[self.i] not in _WORDS and self.k[self.i] != "s":
                self.fail("expected a name")
            self.i += 1
            if self.k[self.i] == _K["as"]:
                self.i += 1
                if self.k[self.i] not in _WORDS and self.k[self.i] != "s":
                    self.fail("expected a name")
                self.i += 1
            if self.k[self.i] == ",":
                self.i += 1
            elif self.k[self.i] != "}":
                self.fail("unexpected token in specifiers")
        self.i += 1

    def export(self) -> None:
        k = self.k
        self.i += 1
        c = k[self.i]
        if c == _K["default"]:
            self.i += 1
            c = k[self.i]
            if c == _K["function"]:
                self.function(False, False)
            elif c == _K["async"] and k[self.i + 1] == _K["function"]:
                self.i += 1
                self.function(True, False)
            elif c == _K["class"]:
                self.class_(False)
            else:
                self.assign()
                self.end()
        elif c == "*":
            self.i += 1
            if k[self.i] == _K["as"]:
                self.i += 2
            self.need(_K["from"], "from")
            self.need("s", "a module name")
            self.attributes()
        elif c == "{":
            self.specifiers()
            if k[self.i] == _K["from"]:
                self.i += 1
                self.need("s", "a module name")
                self.attributes()
            else:
                self.end()
        elif c in (_K["var"], _K["let"], _K["const"], _K["function"], _K["class"], _K["async"]):
            self.statement()
        else:
            self.fail("unexpected token after export")

    # functions and classes

    def name(self) -> None:
        if self.k[self.i] not in _NAMES:
            self.fail("expected a name")
        self.i += 1

    def function_statement(self) -> None:
        self.function(False)

    def function(self, is_async: bool, named: bool = True) -> None:
        self.i += 1
        generator = self.k[self.i] == "*"
        self.i += generator
        if self.k[self.i] in _NAMES:
            self.i += 1
        elif named:
            self.fail("expected a function name")
        self.function_rest(is_async, generator)

    def parameters(self) -> None:
        start = self.i
        stop = self.k.find("{", start)
        if stop > 0 and self.k[start:stop] in _parameter_heads:
            self.i = stop
            return
        self.need("(")
        while self.k[self.i] != ")":
            rest = self.k[self.i] == _K["..."]
            self.i += rest
            self.binding_default()
            if self.k[self.i] == "," and not rest:
                self.i += 1
            elif self.k[self.i] != ")":
                self.fail("unexpected token in parameters")
        self.i += 1
        if self.i == stop and not any(x in self.k[start:stop] for x in _JUMPS):
            _parameter_heads.learn(self.k[start:stop])

    def function_rest(self, is_async: bool, generator: bool) -> None:
        saved = self.loops, self.switches, self.generator, self.async_, self.no_in
        self.loops = self.switches = 0
        self.generator, self.async_, self.no_in = generator, is_async, False
        self.parameters()
        self.functions += 1
        self.block()
        self.functions -= 1
        self.loops, self.switches, self.generator, self.async_, self.no_in = saved

    def arrow_body(self, is_async: bool) -> None:
        if self.broken():
            self.fail("line break before =>")
        self.need(_K["=>"], "=>")
        if self.k[self.i] != "{":
            saved = self.async_
            self.async_ = is_async
            self.assign()
            self.async_ = saved
            return
        saved = self.loops, self.switches, self.generator, self.async_, self.no_in
        self.loops = self.switches = 0
        self.generator, self.async_, self.no_in = False, is_async, False
        self.functions += 1
        self.block()
        self.functions -= 1
        self.loops, self.switches, self.generator, self.async_, self.no_in = saved

    def class_statement(self) -> None:
        self.class_(True)

    def class_(self, named: bool) -> None:
        k = self.k
        self.i += 1
        if k[self.i] in _NAMES:
            self.i += 1
        elif named:
            self.fail("expected a class name")
        if k[self.i] == _K["extends"]:
            self.i += 1
            self.postfix_chain()
        self.need("{")
        while k[self.i] != "}":
            c = k[self.i]
            if c == END:
                self.fail("unexpected end of input")
            if c == ";":
                self.i += 1
                continue
            start = self.i
            try:
                self.member()
            except SyntaxFault as fault:
                self.panic(fault, start)
        self.i += 1

    def member(self) -> None:
        k = self.k
        if k[self.i] == _K["static"] and k[self.i + 1] not in "(=;}":
            self.i += 1
            if k[self.i] == "{":
                return self.block()
        is_async = generator = False
        if k[self.i] == _K["async"] and k[self.i + 1] not in "(=;}":
            is_async = True
            self.i += 1
        if k[self.i] == "*":
            generator = True
            self.i += 1
        if k[self.i] in (_K["get"], _K["set"]) and k[self.i + 1] not in "(=;}":
            self.i += 1
        self.property_name()
        if k[self.i] == "(":
            return self.function_rest(is_async, generator)
        if k[self.i] == "=":
            self.i += 1
            self.assign()
        self.end()

    def property_name(self) -> None:
        c = self.k[self.i]
        if c in _WORDS or c in "s0#":
            self.i += 1
        elif c == "[":
            self.i += 1
            self.assign()
            self.need("]")
        else:
            self.fail("expected a property name")

    # expressions

    def expression(self) -> int:
        kind = self.assign()
        while self.k[self.i] == ",":
            self.i += 1
            self.assign()
            kind = _PLAIN
        return kind

    def assign(self) -> int:
        k = self.k
        c = k[self.i]
        if c in _NAMES:
            after = k[self.i + 1]
            if after == _K["=>"]:
                self.i += 1
                self.arrow_body(False)
                return _PLAIN
            if c == _K["async"] and after in _NAMES and k[self.i + 2] == _K["=>"]:
                self.i += 2
                self.arrow_body(True)
                return _PLAIN
            if c == _K["yield"] and self.generator:
                self.i += 1
                if k[self.i] == "*":
                    self.i += 1
                    self.assign()
                elif k[self.i] not in _ENDS and not self.broken():
                    self.assign()
                return _PLAIN
        kind = self.binary(1)
        c = k[self.i]
        if c == "?":
            self.i += 1
            saved, self.no_in = self.no_in, False
            self.assign()
            self.no_in = saved
            self.need(":")
            self.assign()
            return _PLAIN
        if c in _ASSIGN:
            if kind == _PLAIN or (kind == _PATTERN and c != "="):
                self.fail("invalid assignment target")
            self.i += 1
            self.assign()
            return _PLAIN
        return kind

    def binary(self, least: int) -> int:
        unary = self.k[self.i] in _UNARY
        kind = self.unary()
        while True:
            c = self.k[self.i]
            level = _BINARY.get(c)
            if level is None or level < least or (self.no_in and c == _K["in"]):
                return kind
            if level == _POWER and unary:
                self.fail("unparenthesized unary before **")
            self.i += 1
            self.binary(level if level == _POWER else level + 1)
            unary, kind = False, _PLAIN

    def unary(self) -> int:
        c = self.k[self.i]
        if c in _UNARY or (c == _K["await"] and (self.async_ or not self.functions) and self.k[self.i + 1] not in _ENDS and self.k[self.i + 1] not in ".=(["):
            self.i += 1
            self.unary()
            return _PLAIN
        if c == _K["await"] and self.async_:
            self.i += 1
            self.unary()
            return _PLAIN
        if c == _K["++"] or c == _K["--"]:
            self.i += 1
            if self.unary() != _PLACE:
                self.fail("invalid operand of prefix operation")
            return _PLAIN
        kind = self.postfix_chain()
        c = self.k[self.i]
        if (c == _K["++"] or c == _K["--"]) and not self.broken():
            if kind != _PLACE:
                self.fail("invalid operand of postfix operation")
            self.i += 1
            return _PLAIN
        return kind

    def postfix_chain(self) -> int:
        k = self.k
        kind = self.primary()
        if kind == _PATTERN + 1:  # an arrow function takes no suffix
            return _PLAIN
        while True:
            c = k[self.i]
            if c == ".":
                self.i += 1
                if k[self.i] not in _WORDS and k[self.i] != "#":
                    self.fail("expected a property name")
                self.i += 1
                kind = _PLACE
            elif c == "(":
                self.arguments()
                kind = _PLAIN
            elif c == "[":
                self.i += 1
                saved, self.no_in = self.no_in, False
                self.expression()
                self.no_in = saved
                self.need("]")
                kind = _PLACE
            elif c == _K["?."]:
                self.i += 1
                if k[self.i] in _WORDS or k[self.i] == "#":
                    self.i += 1
                elif k[self.i] not in "([t":
                    self.fail("unexpected token after ?.")
                kind = _PLAIN
            elif c == "t":
                self.i += 1
                kind = _PLAIN
            else:
                return kind

    def arguments(self) -> None:
        self.i += 1
        saved, self.no_in = self.no_in, False
        while self.k[self.i] != ")":
            if self.k[self.i] == _K["..."]:
                self.i += 1
            self.assign()
            if self.k[self.i] == ",":
                self.i += 1
            elif self.k[self.i] != ")":
                self.fail("missing ) after argument list")
        self.no_in = saved
        self.i += 1

    def primary(self) -> int:
        k = self.k
        c = k[self.i]
        if c in _NAMES:
            if c == _K["async"] and k[self.i + 1] == _K["function"]:
                self.i += 1
                self.function(True, False)
                return _PLAIN
            if c == _K["async"] and k[self.i + 1] == "(":
                start = self.i
                self.i += 1
                try:
                    self.parenthesis()
                    if k[self.i] == _K["=>"]:
                        self.arrow_body(True)
                        return _PATTERN + 1
                except SyntaxFault:
                    pass
                self.i = start
            self.i += 1
            return _PLACE
        if c in _VALUES:
            self.i += 1
            return _PLAIN
        if c == "(":
            return self.parenthesis_or_arrow()
        if c == "[":
            return self.array()
        if c == "{":
            return self.object()
        if c == _K["function"]:
            self.function(False, False)
            return _PLAIN
        if c == _K["class"]:
            self.class_(False)
            return _PLAIN
        if c == _K["new"]:
            return self.new()
        if c == _K["super"]:
            self.i += 1
            if k[self.i] not in "(.[":
                self.fail("unexpected super")
            return _PLAIN
        if c == _K["import"]:
            self.i += 1
            if k[self.i] == ".":
                self.i += 2
            elif k[self.i] != "(":
                self.fail("unexpected import")
            return _PLAIN
        if c == "#" and k[self.i + 1] == _K["in"]:
            self.i += 1
            return _PLAIN
        self.fail("unexpected end of input" if c == END else "unexpected token")
        return _PLAIN

    def parenthesis_or_arrow(self) -> int:
        start = self.i
        cover, kind = self.parenthesis()
        if self.k[self.i] == _K["=>"]:
            self.arrow_body(False)
            return _PATTERN + 1
        if cover:
            self.fail("unexpected token", start + 1)
        return kind if kind == _PLACE else _PLAIN

    def parenthesis(self) -> tuple[bool, int]:
        """Whether only an arrow function may begin so, and what the content can be assigned as."""
        k = self.k
        self.i += 1
        saved, self.no_in = self.no_in, False
        cover, kind, n = k[self.i] == ")", _PLAIN, 0
        while k[self.i] != ")":
            if k[self.i] == _K["..."]:
                self.i += 1
                self.binding()
                cover = True
                if k[self.i] != ")":
                    self.fail("unexpected token after rest")
                break
            kind = self.assign()
            n += 1
            if k[self.i] == ",":
                self.i += 1
                cover = cover or k[self.i] == ")"
            elif k[self.i] != ")":
                self.fail("missing )")
        self.no_in = saved
        self.i += 1
        return cover, kind if n == 1 else _PLAIN

    def array(self) -> int:
        self.i += 1
        saved, self.no_in = self.no_in, False
        pattern = True
        while self.k[self.i] != "]":
            if self.k[self.i] == ",":
                self.i += 1
                continue
            if self.k[self.i] == _K["..."]:
                self.i += 1
            start = self.i
            if self.assign() == _PLAIN and "=" not in self.k[start : self.i]:
                pattern = False
            if self.k[self.i] == ",":
                self.i += 1
            elif self.k[self.i] != "]":
                self.fail("missing ]")
        self.no_in = saved
        self.i += 1
        return _PATTERN if pattern else _PLAIN

    def object(self) -> int:
        k = self.k
        self.need("{")
        saved, self.no_in = self.no_in, False
        pattern = True
        while k[self.i] != "}":
            c = k[self.i]
            if c == _K["..."]:
                self.i += 1
                self.assign()
            else:
                is_async = generator = accessor = False
                if c == _K["async"] and k[self.i + 1] not in "(:,}=":
                    is_async = True
                    self.i += 1
                if k[self.i] == "*":
                    generator = True
                    self.i += 1
                if k[self.i] in (_K["get"], _K["set"]) and k[self.i + 1] not in "(:,}=":
                    accessor = True
                    self.i += 1
                short = k[self.i] in _NAMES
                self.property_name()
                if k[self.i] == "(":
                    self.function_rest(is_async, generator)
                    pattern = False
                elif is_async or generator or accessor:
                    self.fail("unexpected token in object")
                elif k[self.i] == ":":
                    self.i += 1
                    start = self.i
                    if self.assign() == _PLAIN and "=" not in k[start : self.i]:
                        pattern = False
                elif not short:
                    self.fail("unexpected token in object")
                elif k[self.i] == "=":
                    self.i += 1
                    self.assign()
            if k[self.i] == ",":
                self.i += 1
            elif k[self.i] != "}":
                self.fail("unexpected token in object")
        self.no_in = saved
        self.i += 1
        return _PATTERN if pattern else _PLAIN

    def new(self) -> int:
        k = self.k
        self.i += 1
        if k[self.i] == ".":
            self.i += 2
            return _PLAIN
        if k[self.i] == _K["new"]:
            self.new()
        else:
            if k[self.i] == _K["import"]:
                self.fail("cannot use new with import")
            self.primary()
        while True:
            c = k[self.i]
            if c == ".":
                self.i += 1
                if k[self.i] not in _WORDS and k[self.i] != "#":
                    self.fail("expected a property name")
                self.i += 1
            elif c == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif c == "t":
                self.i += 1
            else:
                break
        if k[self.i] == "(":
            self.arguments()
        return _PLAIN


_STATEMENTS = {
    "{": _Parser.block, ";": _Parser.nothing, _K["var"]: _Parser.declaration, _K["const"]: _Parser.declaration, _K["function"]: _Parser.function_statement,
    _K["class"]: _Parser.class_statement, _K["if"]: _Parser.if_, _K["for"]: _Parser.for_, _K["while"]: _Parser.while_, _K["do"]: _Parser.do,
    _K["return"]: _Parser.return_, _K["break"]: _Parser.jump, _K["continue"]: _Parser.jump, _K["throw"]: _Parser.throw, _K["try"]: _Parser.try_,
    _K["switch"]: _Parser.switch, _K["with"]: _Parser.with_, _K["debugger"]: _Parser.word, _K["import"]: _Parser.import_, _K["export"]: _Parser.export,
}


def _parser(text: str, careful: bool) -> _Parser:
    if careful:
        kinds, breaks, _ = _lex_slowly(text)
        return _Parser(kinds, breaks)
    tokens = _LEX.findall(text)
    kinds = "".join(map(_KIND, tokens))
    if "/" in kinds or _K["/="] in kinds or "`" in tokens:
        kinds, breaks, _ = _lex_slowly(text)
        return _Parser(kinds, breaks)
    return _Parser(kinds, None)


def check(source: bytes) -> list[tuple[int, str]]:
    """Syntax errors as (line, message), by line; empty for a source that parses."""
    text = source.decode("utf-8", "replace")
    if text[:1] == "\ufeff":
        text = text[1:]
    if text[:2] == "#!":
        text = "//" + text
    allow(len(text))
    try:
        parser = _parser(text, bool(_LINE_MATTERS.search(text)))
        parser.program()
        if not parser.errors:
            return []
        # line breaks may end statements: again, with them
        kinds, breaks, starts = _lex_slowly(text)
        parser = _Parser(kinds, breaks)
        parser.program()
    except RecursionError:
        return [(1, "nested too deeply")]
    lines = lambda at: text.count("\n", 0, starts[at] if at < len(starts) else len(text)) + 1
    return sorted((lines(at), message) for at, message in parser.errors)
