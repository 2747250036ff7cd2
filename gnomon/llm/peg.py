"""A packrat parser of parsing expressions: every rule's result is kept per position, so parsing is linear.

Expressions match at an offset of the text and give (end, value) or None.  Actions get the
text's offsets, so what they build points back into the source.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class State:
    def __init__(self, text: str) -> None:
        self.text, self.memo = text, {}


class Expr:
    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        raise NotImplementedError


class Term(Expr):
    """A terminal: a regular expression; its value is the (start, end) it covers."""

    def __init__(self, pattern: str, flags: int = 0) -> None:
        self.match = re.compile(pattern, flags).match

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        m = self.match(s.text, i)
        return (m.end(), (i, m.end())) if m else None


class Seq(Expr):
    def __init__(self, *parts: Expr) -> None:
        self.parts = parts

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        values = []
        for p in self.parts:
            got = p.at(s, i)
            if got is None:
                return None
            i = got[0]
            values.append(got[1])
        return i, values


class Choice(Expr):
    def __init__(self, *parts: Expr) -> None:
        self.parts = parts

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        for p in self.parts:
            got = p.at(s, i)
            if got is not None:
                return got
        return None


class Many(Expr):
    def __init__(self, part: Expr, least: int = 0, most: int | None = None) -> None:
        self.part, self.least, self.most = part, least, most

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        values: list = []
        while self.most is None or len(values) < self.most:
            got = self.part.at(s, i)
            if got is None or got[0] == i:
                break
            i = got[0]
            values.append(got[1])
        return (i, values) if len(values) >= self.least else None


def maybe(part: Expr) -> Expr:
    return Many(part, 0, 1)


class Not(Expr):
    def __init__(self, part: Expr) -> None:
        self.part = part

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        return (i, None) if self.part.at(s, i) is None else None


class Rule(Expr):
    """A named expression whose results are kept; `define` allows recursion, `action(text, start, end, value)` builds the value."""

    def __init__(self, action: Callable[[str, int, int, Any], Any] | None = None) -> None:
        self.body: Expr | None = None
        self.action = action

    def define(self, body: Expr) -> Rule:
        self.body = body
        return self

    def at(self, s: State, i: int) -> tuple[int, Any] | None:
        key = (id(self), i)
        if key in s.memo:
            return s.memo[key]
        got = self.body.at(s, i)
        if got is not None and self.action is not None:
            got = (got[0], self.action(s.text, i, got[0], got[1]))
        s.memo[key] = got
        return got

    def parse(self, text: str, start: int = 0) -> tuple[int, Any] | None:
        return self.at(State(text), start)
