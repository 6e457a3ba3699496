"""Java source to symbols and raw references: a tolerant lexer and parser, without any dependency.

The parser keeps no full tree. Declarations are read by recursive descent; statements are scanned for local declarations and
expressions; an expression becomes a small tuple tree that holds just what references need: calls, creations, casts, tests
of type, class literals, names and literals. What can't be read is skipped to the next statement or member, and the file is
marked as having an error.

By design these yield nothing: records, initialisers of fields and initialiser blocks, explicit constructor calls, method
references, and local named classes. A variable-arity parameter isn't part of a signature.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed values of the Java language.
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double", "void"}
MODIFIERS = set("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = set(
    "if else for while do switch case default try catch finally return throw break continue synchronized assert yield new instanceof class interface enum "
    "extends implements import package this super null true false void".split()
)
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<str>\"\"\".*?\"\"\"|"(?:[^"\\\n]|\\.)*")|(?P<chr>'(?:[^'\\\n]|\\.[0-9a-fA-F]*)+')"""
    r"""|(?P<num>0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"""
    r"""|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||[<>=!+\-*/&|^%]=|<<=?|[{}()\[\];,.@?:~!<>=+\-*/&|^%])|(?P<bad>.)""",
    re.DOTALL,
)


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int
    end: int


@dataclass
class Type:
    """A written type: its text, simple name, type arguments, and where it is."""

    text: str
    simple: str
    args: list[Type]
    line: int
    array: bool = False

    def uses(self, top: bool = True) -> list[tuple[str, bool]]:
        """(simple name, is an argument) of every type it names."""
        own = [] if self.simple in PRIMITIVES or self.simple in ("?", "") else [(self.simple, not top)]
        return own + [u for a in self.args for u in a.uses(top and self.simple == "?")]


@dataclass
class Parsed:
    package: str = ""
    imports: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    top_level_types: list[str] = field(default_factory=list)
    type_refs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    type_uses: list[dict] = field(default_factory=list)
    has_error: bool = False


class Unreadable(Exception):
    pass


def tokens(source: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind != "skip":
            out.append(Token(kind, text, line, m.start(), m.end()))
        line += text.count("\n")
        at = m.end()
    out.append(Token("end", "", line, at, at))
    return out


class Parser:
    def __init__(self, source: str):
        self.source, self.toks, self.i, self.out = source, tokens(source), 0, Parsed()
        self.out.has_error = any(t.kind == "bad" for t in self.toks)

    # Tokens

    def peek(self, k: int = 0) -> str:
        return self.toks[min(self.i + k, len(self.toks) - 1)].text

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def next(self) -> Token:
        t = self.toks[self.i]
        if t.kind != "end":
            self.i += 1
        return t

    def take(self, text: str) -> bool:
        if self.tok.text == text and self.tok.kind in ("op", "id"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> Token:
        t = self.tok
        if not self.take(text):
            raise Unreadable(f"{text} at line {t.line}")
        return t

    def name(self) -> str:
        if self.tok.kind != "id":
            raise Unreadable(f"name at line {self.tok.line}")
        return self.next().text

    def skip_brackets(self) -> None:
        """Past a bracketed group that begins here."""
        depth = 0
        while self.tok.kind != "end":
            t = self.next()
            if t.kind == "op":
                depth += (t.text in "({[") - (t.text in ")}]")
                if depth == 0:
                    return

    def recover(self) -> None:
        """Past the rest of a member or statement."""
        self.out.has_error = True
        while self.tok.kind != "end" and self.tok.text != "}":
            if self.tok.text == "{":
                self.skip_brackets()
                return
            if self.tok.text in ("(", "["):
                self.skip_brackets()
            elif self.next().text == ";":
                return

    # Types

    def type(self, arrays: bool = True) -> Type:
        while self.tok.text == "@" and self.peek(1) != "interface":
            self.annotation()
        first, start = self.tok, self.i
        if self.take("?"):
            bound = self.type() if self.take("extends") or self.take("super") else None
            return Type(self.text(start), "?", [bound] if bound else [], first.line)
        simple, args = self.name(), self.type_args() if self.tok.text == "<" else []
        if simple in KEYWORDS - {"void"}:
            raise Unreadable(f"type at line {first.line}")
        while self.tok.text == "." and self.toks[self.i + 1].kind == "id" and self.peek(1) not in KEYWORDS:
            self.i += 1
            simple = self.name()
            if self.tok.text == "<":
                args = self.type_args()
        array = False
        while arrays and self.tok.text == "[" and self.peek(1) == "]":
            self.i += 2
            array = True
        return Type(self.text(start), simple, args, first.line, array)

    def type_args(self) -> list[Type]:
        self.need("<")
        out = []
        while not self.take(">"):
            out.append(self.type())
            while self.take("&"):
                self.type()
            if not self.take(",") and self.tok.text != ">":
                raise Unreadable(f"type arguments at line {self.tok.line}")
        return out

    def type_params(self) -> None:
        """Past the type parameters of a declaration, if there are any."""
        depth = 0
        while self.tok.kind != "end" and (depth or self.tok.text == "<"):
            t = self.next().text
            depth += (t == "<") - (t == ">")

    def text(self, start: int) -> str:
        return self.source[self.toks[start].at : self.toks[self.i - 1].end]

    def use(self, t: Type | None, caller: str, owner: str, context: str) -> None:
        for simple, argument in t.uses() if t else []:
            self.out.type_uses.append({"caller": caller, "owner": owner, "type_name": simple, "context": "generic_arg" if argument else context, "line": t.line})

    # Declarations

    def annotation(self) -> tuple[str, int]:
        line = self.need("@").line
        name = self.name()
        while self.take("."):
            name = self.name()
        if self.tok.text == "(":
            self.skip_brackets()
        return name, line

    def modifiers(self) -> list[tuple[str, int]]:
        out = []
        while True:
            if self.tok.text == "@" and self.peek(1) != "interface":
                out.append(self.annotation())
            elif self.tok.text in MODIFIERS and not (self.tok.text == "default" and self.peek(1) in (":", "->")):
                self.i += 1
            elif self.tok.text == "non" and self.peek(1) == "-":
                self.i += 3
            else:
                return out

    def unit(self) -> Parsed:
        while self.tok.kind != "end":
            start = self.i
            try:
                notes = self.modifiers()
                if self.take("package"):
                    self.out.package = self.dotted()
                    self.need(";")
                elif self.tok.text == "import":
                    self.imported()
                elif not self.take(";") and not self.declared(None, start, notes):
                    raise Unreadable(f"line {self.tok.line}")
            except Unreadable:
                self.recover()
            if self.i == start:
                self.i += 1
        return self.out

    def dotted(self) -> str:
        out = self.name()
        while self.tok.text == "." and self.toks[self.i + 1].kind == "id":
            self.i += 1
            out += "." + self.name()
        return out

    def imported(self) -> None:
        line = self.need("import").line
        static = self.take("static")
        name = self.dotted()
        wild = self.take(".") and self.take("*")
        self.need(";")
        self.out.imports.append({"imported_name": name, "is_wildcard": bool(wild), "is_static": static, "line": line})

    def declared(self, owner: str | None, start: int, notes: list[tuple[str, int]]) -> bool:
        """Read a type declaration, if one is here; its modifiers began at ``start``."""
        if self.tok.text == "@" and self.peek(1) == "interface":
            self.i += 2
            kind = "annotation"
        elif self.tok.text in ("class", "interface", "enum"):
            kind = self.next().text
        elif self.tok.text == "record" and self.toks[self.i + 1].kind == "id" and self.peek(2) in ("(", "<"):
            while self.tok.kind != "end" and self.tok.text != "{":
                self.skip_brackets() if self.tok.text == "(" else self.next()
            self.skip_brackets()
            return True
        else:
            return False
        simple = self.name()
        qname = f"{owner}.{simple}" if owner else f"{self.out.package}.{simple}" if self.out.package else simple
        self.type_params()
        heads = []
        while self.tok.text in ("extends", "implements", "permits"):
            line, verb, at = self.tok.line, self.next().text, []
            at.append(self.type())
            while self.take(","):
                at.append(self.type())
            if verb != "permits":
                heads.append((verb, at, line))
        node = {"kind": kind, "span_start": self.toks[start].line, "qualified_name": qname, "simple_name": simple, "annotations": [n for n, _ in notes]}
        node["signature"] = " ".join([kind, simple, *(f"{v} {', '.join(t.text for t in at)}" for v, at, _ in heads)])
        self.out.nodes.append(node)
        for n, line in notes:
            self.out.type_uses.append({"caller": qname, "owner": qname, "type_name": n, "context": "annotation_type", "line": line})
        if owner is None:
            self.out.top_level_types.append(qname)
        for verb, at, line in heads:
            for t in at:
                self.out.type_refs.append({"subtype": qname, "supertype": t.simple, "edge_type": verb.upper(), "line": line})
        self.body(qname, simple, kind)
        node["span_end"] = self.toks[self.i - 1].line
        return True

    def body(self, owner: str, simple: str, kind: str) -> None:
        self.need("{")
        if kind == "enum":
            self.constants(owner, simple)
        fields = self.fields_ahead() if kind == "class" else {}
        while not self.take("}"):
            if self.tok.kind == "end":
                self.out.has_error = True
                return
            start = self.i
            try:
                self.member(owner, simple, kind, fields)
            except Unreadable:
                self.recover()
            if self.i == start:
                self.i += 1

    def constants(self, owner: str, simple: str) -> None:
        while self.tok.kind == "id" or self.tok.text == "@":
            line = self.tok.line
            while self.tok.text == "@":
                self.annotation()
            name = self.name()
            if self.tok.text == "(":
                self.skip_brackets()
            if self.tok.text == "{":
                self.skip_brackets()
            end = self.toks[self.i - 1].line
            self.out.nodes.append(
                {"kind": "enum_constant", "span_start": line, "span_end": end, "qualified_name": f"{owner}.{name}", "simple_name": name, "signature": f"{simple}.{name}", "annotations": []}
            )
            if not self.take(","):
                break
        self.take(";")

    def fields_ahead(self) -> dict[str, str]:
        """Types of the fields that the body here declares, wherever in it: read first, since methods see them all."""
        at, error, out = self.i, self.out.has_error, {}
        while self.tok.kind != "end" and self.tok.text != "}":
            start = self.i
            try:
                self.modifiers()
                if self.tok.text in ("class", "interface", "enum", "record", "@", "{", "<", ";"):
                    raise Unreadable
                t = self.type()
                name = self.name()
                if self.tok.text == "(":
                    raise Unreadable
                out[name] = t.simple
                self.more_names(lambda n, t=t: out.__setitem__(n, t.simple), None)
            except Unreadable:
                self.i = start
                while self.tok.kind != "end" and self.tok.text not in (";", "}"):
                    if self.tok.text == "{":
                        self.skip_brackets()
                        break
                    self.skip_brackets() if self.tok.text in ("(", "[") else self.next()
                else:
                    self.take(";")
            if self.i == start:
                self.i += 1
        self.i, self.out.has_error = at, error
        return out

    def more_names(self, found, walk) -> None:
        """The rest of a declaration after its first name: dimensions, an initial value, further names, and the semicolon.

        ``walk`` gets each initial value as a tree, or None to pass over it.
        """
        while True:
            while self.take("["):
                self.need("]")
            if self.take("="):
                value = self.array() if self.tok.text == "{" else self.expression()
                if walk:
                    walk(value)
            if not self.take(","):
                break
            found(self.name())
        self.need(";")

    def member(self, owner: str, simple: str, kind: str, fields: dict[str, str]) -> None:
        if self.take(";"):
            return
        start = self.i
        notes = self.modifiers()
        in_enum = kind == "enum"
        at = self.i
        if self.tok.text in ("class", "interface", "enum", "record") or self.tok.text == "@":
            if in_enum:  # types nested in an enum yield nothing
                held = [len(x) for x in (self.out.nodes, self.out.type_refs, self.out.calls, self.out.type_uses)]
                if self.declared(owner, start, notes):
                    for x, n in zip((self.out.nodes, self.out.type_refs, self.out.calls, self.out.type_uses), held, strict=True):
                        del x[n:]
                    return
            elif self.declared(owner, start, notes):
                return
            self.i = at
        if self.tok.text == "{":
            self.skip_brackets()
            return
        self.type_params()
        while self.tok.text == "@":
            self.annotation()
        first = self.toks[start].line
        if self.tok.text == simple and self.peek(1) == "(":
            self.i += 1
            self.callable("constructor", owner, simple, None, first, notes, fields)
            return
        t = self.type()
        name = self.name()
        if self.tok.text == "(":
            held = len(self.out.nodes), len(self.out.type_uses)
            self.callable("method", owner, name, t, first, notes, fields)
            if kind == "annotation":  # its elements are no methods
                del self.out.nodes[held[0] :], self.out.type_uses[held[1] :]
            return
        rows = []

        def one(n: str) -> None:
            rows.append({"kind": "field", "span_start": first, "qualified_name": f"{owner}#{n}", "simple_name": n, "signature": f"{t.text} {n}", "annotations": []})

        one(name)
        self.more_names(one, None)
        if kind != "class":  # constants of the other kinds yield nothing
            return
        for r in rows:
            r["span_end"] = self.toks[self.i - 1].line
            self.out.nodes.append(r)
            self.use(t, r["qualified_name"], owner, "field_type")
            for n, at_line in notes:
                self.out.type_uses.append({"caller": r["qualified_name"], "owner": owner, "type_name": n, "context": "annotation_type", "line": at_line})

    def callable(self, kind: str, owner: str, name: str, returns: Type | None, first: int, notes: list[tuple[str, int]], fields: dict[str, str]) -> None:
        self.need("(")
        params: list[tuple[Type, str]] = []
        while not self.take(")"):
            self.modifiers()
            t = self.type()
            variable = self.take("...")
            if self.tok.text in ("this",) or self.peek(1) == ".":  # a receiver parameter
                while self.tok.text not in (",", ")"):
                    self.next()
            else:
                n = self.name()
                while self.take("["):
                    self.need("]")
                if not variable:
                    params.append((t, n))
            self.take(",")
        while self.take("["):
            self.need("]")
        types = [t.simple for t, _ in params]
        member = "<init>" if kind == "constructor" else name
        qname = f"{owner}#{member}({','.join(types)})"
        shown = f"{name}({', '.join(types)})"
        node = {"kind": kind, "span_start": first, "qualified_name": qname, "simple_name": name, "signature": f"{returns.text} {shown}" if returns else shown, "annotations": [n for n, _ in notes] if returns else []}
        self.out.nodes.append(node)
        for n, line in notes:
            self.out.type_uses.append({"caller": qname, "owner": owner, "type_name": n, "context": "annotation_type", "line": line})
        self.use(returns, qname, owner, "return_type")
        for t, _ in params:
            self.use(t, qname, owner, "param_type")
        if self.take("throws"):
            self.use(self.type(), qname, owner, "throws")
            while self.take(","):
                self.use(self.type(), qname, owner, "throws")
        if self.take("default"):  # of an annotation's element
            self.array() if self.tok.text == "{" else self.annotation() if self.tok.text == "@" else self.expression()
            self.need(";")
        elif self.tok.text == "{":
            scope = {**fields, **{n: t.simple for t, n in params}}
            self.block(Site(qname, owner), scope)
        else:
            self.need(";")
        node["span_end"] = self.toks[self.i - 1].line

    # Statements

    def block(self, site: Site, scope: dict[str, str]) -> None:
        """A braced block: its own local variables are known in all of it."""
        self.need("{")
        self.statements(site, scope, ("}",))
        self.need("}")

    def statements(self, site: Site, scope: dict[str, str], until: tuple[str, ...]) -> None:
        held = []
        own = {}
        while self.tok.kind != "end" and self.tok.text not in until:
            start = self.i
            try:
                held += self.statement(site, scope, own)
            except Unreadable:
                self.i = max(self.i, start)
                self.recover()
            if self.i == start:
                self.i += 1
        inner = {**scope, **own}
        for later in held:
            later(inner)

    def statement(self, site: Site, scope: dict[str, str], own: dict[str, str]) -> list:
        """Read one statement; what needs the block's variables is returned, to be called with them."""
        t = self.tok.text
        if t == "{":
            at = self.i
            self.skip_brackets()

            def nested(inner: dict[str, str]) -> None:
                back, self.i = self.i, at
                self.block(site, inner)
                self.i = back

            return [nested]
        if t == ";":
            self.i += 1
            return []
        if t in ("if", "while", "switch", "synchronized") and self.peek(1) == "(":
            self.i += 1
            out = [self.later(site, self.parenthesised())]
            if t == "switch":
                return out + self.switch_body()(site)
            return out + self.nested_statement(site) + (self.nested_statement(site) if t == "if" and self.take("else") else [])
        if t == "do":
            self.i += 1
            out = self.nested_statement(site)
            self.need("while")
            out.append(self.later(site, self.parenthesised()))
            self.need(";")
            return out
        if t == "for":
            return self.for_statement(site)
        if t == "try":
            return self.try_statement(site)
        if t in ("return", "throw", "yield", "assert") and not (t == "yield" and self.peek(1) in ("=", ".", "(", "++", "--")):
            self.i += 1
            if self.take(";"):
                return []
            out = [self.later(site, self.expression())]
            if self.take(":"):
                out.append(self.later(site, self.expression()))
            self.need(";")
            return out
        if t in ("break", "continue"):
            while not self.take(";"):
                self.next()
            return []
        if self.tok.kind == "id" and self.peek(1) == ":" and t not in ("default", "case"):
            self.i += 2
            return self.statement(site, scope, own)
        at = self.i
        self.modifiers()
        if self.tok.text in ("class", "interface", "enum") or self.tok.text == "record" and self.toks[self.i + 1].kind == "id" and self.peek(2) in ("(", "<"):
            while self.tok.kind != "end" and self.tok.text != "{":
                self.skip_brackets() if self.tok.text == "(" else self.next()
            self.skip_brackets()
            return []
        if (declared := self.local_type()) is not None:
            out = [lambda inner: self.use(declared, site.caller, site.owner, "local_var_type")]

            def found(n: str) -> None:
                own[n] = declared.simple

            found(self.name())
            self.more_names(found, lambda v: out.append(self.later(site, v)))
            return out
        self.i = at
        tree = self.expression()
        self.need(";")
        return [self.later(site, tree)]

    def nested_statement(self, site: Site) -> list:
        own: dict[str, str] = {}
        held = self.statement(site, {}, own)
        return [lambda inner: [h({**inner, **own}) for h in held]]

    def local_type(self) -> Type | None:
        """The type of a local declaration that begins here, before its name; else nothing is read."""
        at = self.i
        if self.tok.kind != "id" or self.tok.text in KEYWORDS:
            return None
        try:
            t = self.type()
            if self.tok.kind == "id" and self.tok.text not in KEYWORDS and self.peek(1) in ("=", ";", ",", "[", ":"):
                return t
        except Unreadable:
            pass
        self.i = at
        return None

    def parenthesised(self) -> tuple:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def for_statement(self, site: Site) -> list:
        self.need("for")
        self.need("(")
        own: dict[str, str] = {}
        out = []
        at = self.i
        self.modifiers()
        declared = self.local_type()
        if declared is not None and self.peek(1) == ":":
            self.i += 2
            out.append(self.later(site, self.expression()))
        elif declared is not None:
            out.append(lambda inner: self.use(declared, site.caller, site.owner, "local_var_type"))

            def found(n: str) -> None:
                own[n] = declared.simple

            found(self.name())
            self.more_names(found, lambda v: out.append(self.later(site, v)))
        else:
            self.i = at
            while not self.take(";"):
                out.append(self.later(site, self.expression()))
                self.take(",")
        if declared is None or own:
            if not self.take(";"):
                out.append(self.later(site, self.expression()))
                self.need(";")
            while self.tok.text != ")":
                out.append(self.later(site, self.expression()))
                self.take(",")
        self.need(")")
        out += self.nested_statement(site)
        return [lambda inner: [h({**inner, **own}) for h in out]]

    def try_statement(self, site: Site) -> list:
        self.need("try")
        out = []
        if self.take("("):
            while not self.take(")"):
                self.modifiers()
                if self.local_type() is not None:
                    self.name()
                    self.need("=")
                out.append(self.later(site, self.expression()))
                self.take(";")
        out += self.nested_statement(site)
        while self.tok.text in ("catch", "finally"):
            if self.next().text == "catch":
                self.skip_brackets()
            out += self.nested_statement(site)
        return out

    def switch_body(self):
        """The groups of a switch, each a block of its own; returns what reads them for a site."""
        at = self.i
        self.skip_brackets()

        def of(site: Site) -> list:
            def run(inner: dict[str, str]) -> None:
                back, self.i = self.i, at
                self.need("{")
                while not self.take("}"):
                    if self.tok.kind == "end":
                        break
                    if self.take("case") or self.take("default"):
                        depth = 0
                        while self.tok.kind != "end" and (depth or self.tok.text not in (":", "->")):
                            depth += (self.tok.text in ("(", "[")) - (self.tok.text in (")", "]"))
                            self.next()
                        self.next()
                        continue
                    self.statements(site, inner, ("case", "default", "}"))
                self.i = back

            return [run]

        return of

    # Expressions: trees are (kind, line, ...)

    def expression(self) -> tuple:
        line = self.tok.line
        parts = [self.unary()]
        while True:
            t = self.tok.text
            if t == "instanceof":
                self.i += 1
                self.take("final")
                tested = self.type()
                if self.tok.kind == "id" and self.tok.text not in KEYWORDS:
                    self.name()
                elif self.tok.text == "(":
                    self.skip_brackets()
                parts = [("instanceof", line, _group(line, parts), tested)]
            elif t == "?":
                self.i += 1
                parts.append(self.expression())
                self.need(":")
                parts.append(self.expression())
            elif t in ("=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<", "<<="):
                self.i += 1
                while self.tok.text in (">", ">=") and t == ">":
                    self.i += 1
                parts.append(self.unary())
            else:
                return _group(line, parts)

    def unary(self) -> tuple:
        line, t = self.tok.line, self.tok.text
        if t in ("+", "-", "!", "~", "++", "--") and self.tok.kind == "op":
            self.i += 1
            return ("other", line, [self.unary()])
        if t == "(":
            if self.lambda_ahead():
                return self.lambda_tree(line)
            if (cast := self.cast()) is not None:
                return ("cast", line, cast, self.unary())
        return self.postfix(self.primary())

    def lambda_ahead(self) -> bool:
        at = self.i
        self.skip_brackets()
        found = self.tok.text == "->"
        self.i = at
        return found

    def lambda_tree(self, line: int) -> tuple:
        if self.tok.text == "(":
            self.skip_brackets()
        else:
            self.next()
        self.need("->")
        if self.tok.text == "{":
            at = self.i
            self.skip_brackets()
            return ("code", line, at)
        return ("other", line, [self.expression()])

    def cast(self) -> Type | None:
        """The type of a cast that begins here; else nothing is read."""
        at = self.i
        self.next()
        try:
            t = self.type()
            while self.take("&"):
                self.type()
            if self.take(")"):
                n = self.tok
                primitive = t.simple in PRIMITIVES and not t.array
                if n.kind in ("str", "chr", "num") or n.text in ("(", "!", "~") or n.kind == "id" and n.text != "instanceof" or primitive and n.text in ("+", "-", "++", "--"):
                    return t
        except Unreadable:
            pass
        self.i = at
        return None

    def primary(self) -> tuple:
        t = self.tok
        line = t.line
        if t.kind == "str":
            return ("literal", self.next().line, "String")
        if t.kind == "chr":
            return ("literal", self.next().line, "char")
        if t.kind == "num":
            text = self.next().text
            hexadecimal = text[:2] in ("0x", "0X")
            floating = "." in text or (not hexadecimal and text[-1] in "fFdDeE") or (not hexadecimal and "e" in text.lower()) or hexadecimal and "p" in text.lower()
            return ("literal", line, ("float" if text[-1] in "fF" else "double") if floating else "long" if text[-1] in "lL" else "int")
        if t.text in ("true", "false", "null") and t.kind == "id":
            return ("literal", self.next().line, "null" if t.text == "null" else "boolean")
        if t.text == "(":
            self.i += 1
            inner = self.expression()
            self.need(")")
            return ("other", line, [inner])
        if t.text == "new":
            return self.creation(None)
        if t.text == "switch" and self.peek(1) == "(":
            self.i += 1
            return ("switch", line, self.parenthesised(), self.switch_body())
        if t.text == "{":
            return self.array()
        if t.kind != "id" or t.text in KEYWORDS - {"this", "super", "void"}:
            raise Unreadable(f"expression at line {line}")
        if self.peek(1) == "->":
            return self.lambda_tree(line)
        if t.text in PRIMITIVES or self.peek(1) == "<" or self.peek(1) == "[" and self.peek(2) == "]" or self.peek(1) == ".":
            at = self.i  # a class literal, or the type of a method reference
            try:
                named = self.type()
                if self.tok.text == "." and self.peek(1) == "class":
                    self.i += 2
                    return ("class", line, named)
                if self.tok.text == "::":
                    self.i += 2
                    return ("other", line, [])
            except Unreadable:
                pass
            self.i = at
        self.i += 1
        if self.tok.text == "(":
            if t.text in ("this", "super"):
                return ("other", line, self.arguments())
            return ("call", line, None, t.text, self.arguments())
        return ("this" if t.text == "this" else "super" if t.text == "super" else "name", line, t.text)

    def array(self) -> tuple:
        line, out = self.need("{").line, []
        while not self.take("}"):
            out.append(self.expression())
            if not self.take(",") and self.tok.text != "}":
                raise Unreadable(f"array at line {self.tok.line}")
        return ("other", line, out)

    def arguments(self) -> list[tuple]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.take(",") and self.tok.text != ")":
                raise Unreadable(f"arguments at line {self.tok.line}")
        return out

    def creation(self, outer: tuple | None) -> tuple:
        line = self.need("new").line
        if self.tok.text == "<":
            self.type_args()
        t = self.type(arrays=False)
        if self.tok.text == "[":
            sizes = []
            while self.take("["):
                if not self.take("]"):
                    sizes.append(self.expression())
                    self.need("]")
            if self.tok.text == "{":
                sizes.append(self.array())
            return ("new_array", line, t, sizes)
        args, body = self.arguments(), None
        if self.tok.text == "{":
            body = self.i
            self.skip_brackets()
        return ("new", line, t, args, body, outer)

    def postfix(self, tree: tuple) -> tuple:
        while True:
            line = tree[1]
            if self.take("."):
                if self.tok.text == "new":
                    tree = self.creation(tree)
                    continue
                if self.tok.text == "<":
                    self.type_args()
                if self.tok.text == "class":
                    self.i += 1
                    tree = ("other", line, [tree])
                    continue
                name = self.name()
                if self.tok.text == "(":
                    tree = ("call", line, tree, name, self.arguments())
                else:
                    tree = ("field", line, tree, name)
            elif self.take("["):
                tree = ("other", line, [tree, self.expression()])
                self.need("]")
            elif self.take("::"):
                if self.tok.text == "<":
                    self.type_args()
                self.next()
                tree = ("other", line, [tree])
            elif self.tok.text in ("++", "--"):
                self.i += 1
                tree = ("other", line, [tree])
            else:
                return tree

    # References

    def later(self, site: Site, tree: tuple):
        return lambda scope: self.walk(tree, site, scope)

    def walk(self, tree: tuple, site: Site, scope: dict[str, str]) -> None:
        """Emit the references of an expression."""
        kind, line = tree[:2]
        if kind == "call":
            _, _, target, name, args = tree
            receiver, hint = self.receiver(target, scope)
            self.call(site, name, receiver, hint, args, line, scope)
            for t in ([target] if target else []) + args:
                self.walk(t, site, scope)
        elif kind == "new":
            _, _, t, args, body, outer = tree
            self.call(site, "<init>", "type", t.simple, args, line, scope)
            self.use(t, site.caller, site.owner, "object_creation")
            for a in ([outer] if outer else []) + args:
                self.walk(a, site, scope)
            if body is not None:
                self.anonymous(body, site, scope)
        elif kind == "new_array":
            for a in tree[3]:
                self.walk(a, site, scope)
        elif kind == "cast":
            self.use(tree[2], site.caller, site.owner, "cast")
            self.walk(tree[3], site, scope)
        elif kind == "instanceof":
            self.walk(tree[2], site, scope)
            self.use(tree[3], site.caller, site.owner, "instanceof")
        elif kind == "class":
            self.use(tree[2], site.caller, site.owner, "class_literal")
        elif kind == "field":
            self.walk(tree[2], site, scope)
        elif kind == "other":
            for t in tree[2]:
                self.walk(t, site, scope)
        elif kind == "switch":
            self.walk(tree[2], site, scope)
            for run in tree[3](site):
                run(scope)
        elif kind == "code":
            back, self.i = self.i, tree[2]
            self.block(site, scope)
            self.i = back

    def call(self, site: Site, name: str, receiver: str, hint: str | None, args: list[tuple], line: int, scope: dict[str, str]) -> None:
        hints = [self.argument(a, site, scope) for a in args]
        self.out.calls.append(
            {"caller": site.caller, "owner": site.owner, "name": name, "receiver_hint": hint, "receiver_kind": receiver, "argument_count": len(args), "line": line, "argument_hints": hints}
        )

    def receiver(self, tree: tuple | None, scope: dict[str, str]) -> tuple[str, str | None]:
        if tree is None:
            return "unqualified", None
        if tree[0] in ("this", "super"):
            return tree[0], None
        if tree[0] == "name":
            return ("variable", scope[tree[2]]) if tree[2] in scope else ("type", tree[2])
        if tree[0] == "field" and tree[2][0] == "this" and tree[3] in scope:
            return "variable", scope[tree[3]]
        return "chain", None

    def argument(self, tree: tuple, site: Site, scope: dict[str, str]) -> str:
        """Static type of an argument, as far as its file tells: a simple name, ``null``, ``unknown``, or a call to look up."""
        kind = tree[0]
        if kind == "literal":
            return tree[2]
        if kind == "name":
            return scope.get(tree[2], "unknown")
        if kind == "this":
            return site.owner.rsplit(".", 1)[-1]
        if kind in ("cast", "new", "new_array"):
            return tree[2].simple
        if kind == "class":
            return "Class"
        if kind == "field" and tree[2][0] == "this":
            return scope.get(tree[3], "unknown")
        if kind == "call" and (tree[2] is None or tree[2][0] == "name"):
            owner = "this" if tree[2] is None else scope.get(tree[2][2], tree[2][2])
            return f"@call:{owner}:{tree[3]}:{len(tree[4])}"
        return "unknown"

    def anonymous(self, at: int, site: Site, scope: dict[str, str]) -> None:
        """An anonymous class: what its members do is the site's doing, and its fields are in scope."""
        back, self.i = self.i, at
        self.need("{")
        inner = {**scope, **self.fields_ahead()}
        while not self.take("}"):
            if self.tok.kind == "end":
                break
            start = self.i
            try:
                self.anonymous_member(site, inner)
            except Unreadable:
                self.recover()
            if self.i == start:
                self.i += 1
        self.i = back

    def anonymous_member(self, site: Site, scope: dict[str, str]) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if self.tok.text == "{":
            self.block(site, scope)
            return
        if self.tok.text in ("class", "interface", "enum"):
            while self.tok.kind != "end" and self.tok.text != "{":
                self.next()
            self.skip_brackets()
            return
        self.type_params()
        self.type()
        self.name()
        if self.tok.text == "(":
            self.skip_brackets()
            if self.take("throws"):
                self.type()
                while self.take(","):
                    self.type()
            if self.tok.text == "{":
                self.block(site, scope)
            else:
                self.need(";")
            return
        self.more_names(lambda n: None, lambda v: self.walk(v, site, scope))


@dataclass
class Site:
    caller: str
    owner: str


def _group(line: int, parts: list[tuple]) -> tuple:
    return parts[0] if len(parts) == 1 else ("other", line, parts)


def parse(source: str) -> Parsed:
    """Symbols and raw references of one file. Nothing raises: a file too deeply nested to read has an error and no members."""
    p = Parser(source)
    try:
        return p.unit()
    except RecursionError:
        p.out.has_error = True
        return p.out
