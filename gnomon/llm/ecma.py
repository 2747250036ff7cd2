"""Recognises ECMAScript modules: a recursive-descent reader with lexing on demand.

It answers whether a text is a module and, if not, where reading stopped.  Early errors that need
scopes (names declared twice, exports without a declaration) are not judged.
"""

from __future__ import annotations

import sys

import regex

_SKIP = regex.compile(r"(?:[\s﻿ ]|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*+\*/)*+")
_LINE = regex.compile(r"[\n\r  ]")
_WORD = regex.compile(r"#?(?:[\p{ID_Start}$_]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\p{ID_Continue}$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*+")
_NUMBER = regex.compile(
    r"0[xX][0-9A-Fa-f]+(?:_[0-9A-Fa-f]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9](?:_?\d)*)n|(?:(?:0(?!\d)|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
)
_STRING = regex.compile(r"\"(?:[^\"\\\n\r]|\\(?:\r\n|[^\r]|\r))*+\"|'(?:[^'\\\n\r]|\\(?:\r\n|[^\r]|\r))*+'", regex.S)
_TEMPLATE = regex.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", regex.S)
_REGEX = regex.compile(r"/(?![*/])(?:[^/\\\[\n\r  ]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/[A-Za-z]*+")
_SIGN = regex.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")

#: The language's reserved words in modules.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with implements interface let package private protected public static yield await".split()
)
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_UNARY = frozenset("delete void typeof + - ~ !".split())
NAME, NUM, STR, SIGN, TICK, PRIVATE, END = range(7)
DEEPEST = 20_000  # nested expressions and blocks; beyond it the reader gives up with RecursionError


class NotAModule(Exception):
    pass


class Module:
    def __init__(self, text: str) -> None:
        self.s, self.i = text, 0
        self.fn, self.is_async, self.gen, self.no_in, self.depth = False, True, False, False, 0
        if text.startswith("#!"):
            m = _LINE.search(text)
            self.i = m.start() if m else len(text)
        self.next()

    # lexing ---------------------------------------------------------------
    def fail(self) -> None:
        raise NotAModule(str(self.start))

    def next(self) -> None:
        s, a = self.s, self.i
        i = _SKIP.match(s, a).end()
        self.newline = i > a and _LINE.search(s, a, i) is not None
        self.start = i
        if i >= len(s):
            self.kind, self.v, self.i = END, "", i
            return
        c = s[i]
        if c == "`":
            self.kind, self.v, self.i = TICK, "`", i + 1
            return
        if c in "\"'":
            m, kind = _STRING.match(s, i), STR
        elif c.isdigit() or (c == "." and s[i + 1 : i + 2].isdigit()):
            m, kind = _NUMBER.match(s, i), NUM
            if m and _WORD.match(s, m.end()):
                self.fail()
            if m and s[m.end() : m.end() + 1].isdigit():
                self.fail()
        elif m := _WORD.match(s, i):
            kind = PRIVATE if c == "#" else NAME
        else:
            m, kind = _SIGN.match(s, i), SIGN
        if not m:
            self.fail()
        self.kind, self.v, self.i = kind, m[0], m.end()

    def save(self) -> tuple:
        return self.i, self.kind, self.v, self.start, self.newline

    def load(self, x: tuple) -> None:
        self.i, self.kind, self.v, self.start, self.newline = x

    def sign(self, v: str) -> bool:
        return self.v == v and self.kind == SIGN

    def word(self, v: str) -> bool:
        return self.v == v and self.kind == NAME

    def eat(self, v: str) -> bool:
        if self.v == v and self.kind in (SIGN, NAME):
            self.next()
            return True
        return False

    def need(self, v: str) -> None:
        if not self.eat(v):
            self.fail()

    def semicolon(self) -> None:
        if self.sign(";"):
            self.next()
        elif not (self.sign("}") or self.kind == END or self.newline):
            self.fail()

    def peek(self) -> tuple[int, str, bool]:
        at = self.save()
        try:
            self.next()
            return self.kind, self.v, self.newline
        except NotAModule:
            return END, "", False
        finally:
            self.load(at)

    # statements -------------------------------------------------------------
    def module(self) -> None:
        while self.kind != END:
            if self.word("import") and self.peek()[1] not in ("(", "."):
                self.imports()
            elif self.word("export"):
                self.exports()
            else:
                self.statement()

    def string(self) -> None:
        if self.kind != STR:
            self.fail()
        self.next()

    def module_name(self) -> None:
        if self.kind not in (NAME, STR):
            self.fail()
        self.next()

    def attributes(self) -> None:
        if self.word("with") or (self.word("assert") and not self.newline):
            self.next()
            self.need("{")
            while not self.sign("}"):
                self.module_name()
                self.need(":")
                self.string()
                if not self.eat(","):
                    break
            self.need("}")

    def imports(self) -> None:
        self.next()
        if self.kind == STR:
            self.next()
        else:
            named = False
            if self.kind == NAME and not self.sign("{"):
                self.identifier()
                named = True
            if not named or self.eat(","):
                if self.eat("*"):
                    self.need("as")
                    self.identifier()
                else:
                    self.need("{")
                    while not self.sign("}"):
                        self.specifier(True)
                        if not self.eat(","):
                            break
                    self.need("}")
            self.need("from")
            self.string()
        self.attributes()
        self.semicolon()

    def specifier(self, local: bool) -> None:
        kind, v = self.kind, self.v
        self.module_name()
        if self.word("as"):
            self.next()
            if local:
                self.identifier()
            else:
                self.module_name()
        elif local and (kind == STR or v in RESERVED):
            self.fail()

    def exports(self) -> None:
        self.next()
        if self.eat("*"):
            if self.eat("as"):
                self.module_name()
            self.need("from")
            self.string()
            self.attributes()
            self.semicolon()
        elif self.eat("{"):
            while not self.sign("}"):
                self.specifier(False)
                if not self.eat(","):
                    break
            self.need("}")
            if self.eat("from"):
                self.string()
                self.attributes()
            self.semicolon()
        elif self.eat("default"):
            if self.word("function") or self.word("class") or (self.word("async") and self.peek()[1] == "function" and not self.peek()[2]):
                self.declared(True)
            else:
                self.assignment()
                self.semicolon()
        elif self.v in ("var", "let", "const"):
            self.variables()
            self.semicolon()
        else:
            self.declared(False)

    def declared(self, anonymous: bool) -> None:
        if self.word("class"):
            self.klass(not anonymous)
            return
        is_async = self.eat("async")
        if not self.word("function"):
            self.fail()
        self.next()
        gen = self.eat("*")
        if self.kind == NAME:
            self.identifier()
        elif not anonymous:
            self.fail()
        self.function(is_async, gen)

    def block(self) -> None:
        self.need("{")
        self.depth += 1
        if self.depth > DEEPEST:
            raise RecursionError
        while not self.sign("}"):
            if self.kind == END:
                self.fail()
            self.statement()
        self.depth -= 1
        self.next()

    def statement(self) -> None:
        v, kind = self.v, self.kind
        if kind == SIGN:
            if v == "{":
                return self.block()
            if v == ";":
                return self.next()
        elif kind == NAME:
            if v in ("var", "const") or (v == "let" and (self.peek()[0] == NAME or self.peek()[1] in ("[", "{"))):
                self.variables()
                return self.semicolon()
            if v == "function" or v == "class":
                return self.declared(False)
            if v == "async":
                k, w, nl = self.peek()
                if w == "function" and not nl:
                    return self.declared(False)
            method = self.WORDS.get(v)
            if method:
                return method(self)
            if v in ("import", "export") and (v == "export" or self.peek()[1] not in ("(", ".")):
                self.fail()
            if v not in RESERVED and self.peek()[1] == ":":
                self.next()
                self.next()
                return self.statement()
        self.expression()
        self.semicolon()

    def head(self) -> None:
        self.next()
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.head()
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self) -> None:
        self.head()
        self.statement()

    def s_do(self) -> None:
        self.next()
        self.statement()
        if not self.word("while"):
            self.fail()
        self.head()
        self.eat(";")

    def s_for(self) -> None:
        self.next()
        waits = self.eat("await")
        self.need("(")
        if self.sign(";"):
            pass
        else:
            keep, self.no_in = self.no_in, True
            if self.v in ("var", "const") or (self.word("let") and (self.peek()[0] == NAME or self.peek()[1] in ("[", "{"))):
                self.variables(True)
            else:
                self.expression()
            self.no_in = keep
            if self.word("of"):
                self.next()
                self.assignment()
                self.need(")")
                return self.statement()
            if self.word("in") and not waits:
                self.next()
                self.expression()
                self.need(")")
                return self.statement()
        if waits:
            self.fail()
        self.need(";")
        if not self.sign(";"):
            self.expression()
        self.need(";")
        if not self.sign(")"):
            self.expression()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        if not self.fn:
            self.fail()
        self.next()
        if not (self.sign(";") or self.sign("}") or self.kind == END or self.newline):
            self.expression()
        self.semicolon()

    def s_jump(self) -> None:
        self.next()
        if self.kind == NAME and not self.newline:
            self.identifier()
        self.semicolon()

    def s_throw(self) -> None:
        self.next()
        if self.newline:
            self.fail()
        self.expression()
        self.semicolon()

    def s_try(self) -> None:
        self.next()
        self.block()
        caught = False
        if self.eat("catch"):
            caught = True
            if self.eat("("):
                self.binding()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail()

    def s_switch(self) -> None:
        self.head()
        self.need("{")
        while not self.sign("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.sign("}") or self.word("case") or self.word("default")):
                if self.kind == END:
                    self.fail()
                self.statement()
        self.next()

    def s_debugger(self) -> None:
        self.next()
        self.semicolon()

    WORDS = {"if": s_if, "while": s_while, "do": s_do, "for": s_for, "return": s_return, "break": s_jump, "continue": s_jump, "throw": s_throw, "try": s_try, "switch": s_switch, "debugger": s_debugger}

    # bindings -----------------------------------------------------------------
    def identifier(self) -> None:
        if self.kind != NAME or self.v in RESERVED:
            self.fail()
        self.next()

    def variables(self, in_for: bool = False) -> None:
        const = self.v == "const"
        self.next()
        while True:
            pattern = self.sign("[") or self.sign("{")
            self.binding()
            if self.eat("="):
                self.assignment()
            elif (const or pattern) and not (in_for and self.v in ("of", "in")):
                self.fail()
            if not self.eat(","):
                return

    def binding(self) -> None:
        if self.eat("["):
            while not self.sign("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if self.eat("=") and not rest:
                    self.assignment()
                if not self.sign("]"):
                    self.need(",")
            self.next()
        elif self.eat("{"):
            while not self.sign("}"):
                if self.eat("..."):
                    self.identifier()
                else:
                    plain = self.kind == NAME and self.v not in RESERVED
                    self.key()
                    if self.eat(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.eat("="):
                        self.assignment()
                if not self.sign("}"):
                    self.need(",")
            self.next()
        else:
            self.identifier()

    def key(self) -> None:
        if self.eat("["):
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need("]")
        elif self.kind in (NAME, NUM, STR, PRIVATE):
            self.next()
        else:
            self.fail()

    def function(self, is_async: bool, gen: bool) -> None:
        keep = self.fn, self.is_async, self.gen, self.no_in
        self.fn, self.is_async, self.gen, self.no_in = True, is_async, gen, False
        self.need("(")
        while not self.sign(")"):
            rest = self.eat("...")
            self.binding()
            if self.eat("="):
                self.assignment()
            if not self.sign(")"):
                if rest:
                    self.fail()
                self.need(",")
        self.next()
        self.block()
        self.fn, self.is_async, self.gen, self.no_in = keep

    def klass(self, named: bool) -> None:
        self.next()
        if self.kind == NAME and not self.word("extends"):
            self.identifier()
        elif named:
            self.fail()
        if self.eat("extends"):
            self.unary_tail()
        self.need("{")
        while not self.sign("}"):
            if not self.eat(";"):
                self.member()
        self.next()

    def member(self) -> None:
        """A method or field of a class."""
        if self.word("static") and self.peek()[1] not in ("(", "=", ";", "}"):
            self.next()
            if self.sign("{"):
                keep = self.fn, self.is_async, self.gen
                self.fn, self.is_async, self.gen = False, False, False
                self.block()
                self.fn, self.is_async, self.gen = keep
                return
        if self.method():
            return
        if self.eat("="):
            keep = self.fn, self.is_async
            self.is_async = False
            self.assignment()
            self.fn, self.is_async = keep
        self.semicolon()

    def method(self) -> bool:
        """Reads a key; True if a method follows it."""
        is_async = gen = accessor = False
        if self.kind == NAME and self.v in ("get", "set", "async"):
            k, w, nl = self.peek()
            if (k in (NAME, NUM, STR, PRIVATE) or w in ("[", "*")) and not (nl and self.v == "async"):
                if not (w == "*" and self.v != "async"):
                    is_async, accessor = self.v == "async", self.v != "async"
                    self.next()
        if self.eat("*"):
            gen = True
        self.key()
        if self.sign("("):
            self.function(is_async, gen)
            return True
        if is_async or gen or accessor:
            self.fail()
        return False

    # expressions ----------------------------------------------------------------
    def expression(self) -> str:
        kind = self.assignment()
        while self.eat(","):
            self.assignment()
            kind = "list"
        return kind

    def assignment(self) -> str:
        self.depth += 1
        if self.depth > DEEPEST:
            raise RecursionError
        try:
            if self.kind == NAME:
                if self.v == "yield" and self.gen:
                    self.next()
                    if not self.newline:
                        if self.eat("*"):
                            self.assignment()
                        elif not (self.kind == END or (self.kind == SIGN and self.v in (")", "]", "}", ",", ";", ":"))):
                            self.assignment()
                    return "value"
                if self.v == "async":
                    k, w, nl = self.peek()
                    if k == NAME and w not in RESERVED and not nl and w not in ("of", "in"):
                        at = self.save()
                        self.next()
                        self.next()
                        if self.sign("=>") and not self.newline:
                            self.arrow(True)
                            return "arrow"
                        self.load(at)
            start = self.save()
            kind = self.conditional()
            if self.kind == SIGN and self.v in _ASSIGN:
                if kind not in ("name", "member") and not (kind == "pattern" and self.v == "="):
                    self.fail()
                self.next()
                self.assignment()
                return "value"
            if self.sign("=>") and not self.newline and kind in ("name", "params", "paren", "call-async"):
                self.arrow(kind == "call-async" or start[2] == "async" and kind != "name")
                return "arrow"
            if kind in ("params",):
                self.fail()
            return kind
        finally:
            self.depth -= 1

    def arrow(self, is_async: bool) -> None:
        self.need("=>")
        keep = self.fn, self.is_async, self.gen, self.no_in
        self.is_async, self.gen = is_async, False
        if self.sign("{"):
            self.fn, self.no_in = True, False
            self.block()
        else:
            self.assignment()
        self.fn, self.is_async, self.gen, self.no_in = keep

    def conditional(self) -> str:
        kind = self.binary(0)
        if self.sign("?"):
            self.next()
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need(":")
            self.assignment()
            return "value"
        return kind

    def binary(self, least: int) -> str:
        if self.kind == PRIVATE:
            self.next()
            if not self.word("in"):
                self.fail()
            kind = "value"
        else:
            kind = self.unary()
        while True:
            power = _BINARY.get(self.v, 0) if self.kind == SIGN or self.v in ("in", "instanceof") and self.kind == NAME else 0
            if not power or power <= least or (self.v == "in" and self.no_in):
                return kind
            if kind in ("params", "arrow"):
                self.fail()
            if self.v == "**":
                if kind == "unary":
                    self.fail()
                self.next()
                self.binary(power - 1)
            else:
                self.next()
                self.binary(power)
            kind = "value"

    def unary(self) -> str:
        if self.v in _UNARY and self.kind in (SIGN, NAME):
            self.next()
            self.unary()
            return "unary"
        if self.kind == SIGN and self.v in ("++", "--"):
            self.next()
            if self.unary() not in ("name", "member"):
                self.fail()
            return "value"
        if self.word("await"):
            if not self.is_async:
                self.fail()
            self.next()
            self.unary()
            return "unary"
        kind = self.unary_tail()
        if self.kind == SIGN and self.v in ("++", "--") and not self.newline:
            if kind not in ("name", "member"):
                self.fail()
            self.next()
            return "value"
        return kind

    def arguments(self) -> None:
        self.need("(")
        keep, self.no_in = self.no_in, False
        while not self.sign(")"):
            self.eat("...")
            self.assignment()
            if not self.sign(")"):
                self.need(",")
        self.no_in = keep
        self.next()

    def unary_tail(self) -> str:
        """A primary expression with its members, calls and templates."""
        is_async = self.word("async")
        kind = self.primary()
        while True:
            if kind in ("arrow", "params"):
                return kind
            if self.kind == TICK:
                self.template()
                kind = "value"
            elif self.kind != SIGN:
                return kind
            elif self.v == ".":
                self.next()
                if self.kind not in (NAME, PRIVATE):
                    self.fail()
                self.next()
                kind = "member"
            elif self.v == "?.":
                self.next()
                if self.sign("("):
                    self.arguments()
                elif self.sign("["):
                    self.next()
                    self.expression()
                    self.need("]")
                elif self.kind in (NAME, PRIVATE):
                    self.next()
                else:
                    self.fail()
                kind = "value"
            elif self.v == "[":
                self.next()
                keep, self.no_in = self.no_in, False
                self.expression()
                self.no_in = keep
                self.need("]")
                kind = "member"
            elif self.v == "(":
                was_async = is_async and kind == "name"
                self.arguments()
                kind = "call-async" if was_async and self.sign("=>") else "value"
                is_async = False
            else:
                return kind

    def template(self) -> None:
        i = self.i
        while True:
            i = _TEMPLATE.match(self.s, i).end()
            if i >= len(self.s):
                self.fail()
            if self.s[i] == "`":
                self.i = i + 1
                self.next()
                return
            self.i = i + 2  # ${
            self.next()
            keep, self.no_in = self.no_in, False
            self.expression()
            self.no_in = keep
            if not self.sign("}"):
                self.fail()
            i = self.start + 1

    def primary(self) -> str:
        kind, v = self.kind, self.v
        if kind == NAME:
            if v not in RESERVED:
                if v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                    self.next()
                    self.next()
                    gen = self.eat("*")
                    if self.kind == NAME:
                        self.identifier()
                    self.function(True, gen)
                    return "value"
                self.next()
                return "name"
            if v in ("this", "null", "true", "false"):
                self.next()
                return "value"
            if v == "function":
                self.next()
                gen = self.eat("*")
                if self.kind == NAME:
                    self.identifier()
                self.function(False, gen)
                return "value"
            if v == "class":
                self.klass(False)
                return "value"
            if v == "new":
                self.next()
                if self.eat("."):
                    if not self.word("target"):
                        self.fail()
                    self.next()
                    return "value"
                self.construct()
                return "value"
            if v == "super":
                self.next()
                if not (self.sign("(") or self.sign(".") or self.sign("[")):
                    self.fail()
                return "value"
            if v == "import":
                self.next()
                if self.eat("."):
                    if self.kind != NAME:
                        self.fail()
                    self.next()
                elif self.sign("("):
                    self.arguments()
                else:
                    self.fail()
                return "value"
            self.fail()
        if kind in (NUM, STR):
            self.next()
            return "value"
        if kind == TICK:
            self.template()
            return "value"
        if kind == SIGN:
            if v == "(":
                return self.parenthesis()
            if v == "[":
                self.next()
                keep, self.no_in = self.no_in, False
                while not self.sign("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.sign("]"):
                        self.need(",")
                self.no_in = keep
                self.next()
                return "pattern"
            if v == "{":
                return self.literal()
            if v in ("/", "/="):
                m = _REGEX.match(self.s, self.start)
                if not m:
                    self.fail()
                self.i = m.end()
                self.next()
                return "value"
        self.fail()
        return ""

    def construct(self) -> None:
        if self.word("new"):
            self.next()
            self.construct()
        elif self.primary() in ("params",):
            self.fail()
        while True:
            if self.sign("."):
                self.next()
                if self.kind not in (NAME, PRIVATE):
                    self.fail()
                self.next()
            elif self.sign("["):
                self.next()
                self.expression()
                self.need("]")
            elif self.kind == TICK:
                self.template()
            elif self.sign("("):
                self.arguments()
                return
            else:
                return

    def parenthesis(self) -> str:
        """A parenthesised expression or the parameters of an arrow function."""
        self.next()
        keep, self.no_in = self.no_in, False
        only_params = self.sign(")")
        kind, n = "", 0
        while not self.sign(")"):
            if self.eat("..."):
                self.binding()
                only_params = True
                break
            kind = self.assignment()
            n += 1
            if self.sign(")"):
                break
            self.need(",")
            if self.sign(")"):
                only_params = True
        self.no_in = keep
        self.need(")")
        if only_params:
            if not self.sign("=>"):
                self.fail()
            return "params"
        if self.sign("=>"):
            return "paren"
        return kind if n == 1 and kind in ("name", "member") else "value"

    def literal(self) -> str:
        self.next()
        keep, self.no_in = self.no_in, False
        while not self.sign("}"):
            if self.eat("..."):
                self.assignment()
            else:
                plain = self.kind == NAME and (self.v not in RESERVED)
                if not self.method():
                    if self.eat(":"):
                        self.assignment()
                    elif not plain:
                        self.fail()
                    elif self.eat("="):
                        self.assignment()
            if not self.sign("}"):
                self.need(",")
        self.no_in = keep
        self.next()
        return "pattern"


def is_module(text: str) -> bool:
    """Whether the whole text is a module; RecursionError where it is nested beyond DEEPEST."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 30 * DEEPEST))  # frames of Python functions are kept on the heap
    try:
        Module(text).module()
    except NotAModule:
        return False
    return True
