"""Trigrams that a regular expression requires, and an index of lines by such trigrams."""

from __future__ import annotations

import re
import re._parser as parser  # the standard library's parser of patterns
from collections.abc import Iterable, Iterator
from re._constants import ASSERT, ASSERT_NOT, AT, BRANCH, GROUPREF, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN

import numpy as np

Clauses = list[frozenset[str]] | None  # any of these sets of trigrams; None: nothing is required
MOST_EXACT = 64  # strings kept as alternatives while a pattern is read


def _of(strings: set[str]) -> Clauses:
    out = []
    for s in strings:
        if len(s) < 3:
            return None
        last = len(s) - 3
        out.append(frozenset(s[k : k + 3] for k in {0, last, last // 2}))  # three of them tell enough
    return out


def _better(a: Clauses, b: Clauses) -> Clauses:
    """Both must hold; keep the one that says more (longer sets, fewer of them)."""
    if a is None or b is None:
        return b if a is None else a
    rank = lambda c: (min(map(len, c)), -len(c))
    return max(a, b, key=rank)


def _read(items: Iterable) -> tuple[set[str] | None, Clauses]:
    """(all strings the items match, or None), clauses."""
    run: set[str] = {""}
    whole, need = True, None
    for op, arg in items:
        exact: set[str] | None = None
        own: Clauses = None
        if op is LITERAL:
            exact = {chr(arg).lower()}
        elif op is IN and all(o is LITERAL for o, _ in arg) and len(arg) <= 8:
            exact = {chr(a).lower() for _, a in arg}
        elif op is SUBPATTERN:
            exact, own = _read(arg[3])
        elif op is BRANCH:
            parts = [_read(x) for x in arg[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                each = [_of(e) if e is not None else c for e, c in parts]
                own = None if any(c is None for c in each) else [x for c in each for x in c]
        elif op in (MAX_REPEAT, MIN_REPEAT):
            low, high, inner = arg
            e, c = _read(inner)
            if (low, high) == (0, 1) and e is not None:
                exact = e | {""}
            elif low == high == 1:
                exact, own = e, c
            elif low:
                own = _of(e) if e is not None else c
        elif op in (ASSERT, ASSERT_NOT, AT, GROUPREF):
            if op in (AT, ASSERT, ASSERT_NOT):
                continue
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        need = _better(need, _of(run))
        whole = False
        if exact is not None:
            run = exact
        else:
            need = _better(need, own)
            run = {""}
    return (run, _of(run)) if whole else (None, _better(need, _of(run)))


def required(pattern: str) -> Clauses:
    """Sets of lower-case trigrams of which a matching text must hold one whole set."""
    exact, clauses = _read(parser.parse(pattern))
    return _of(exact) if exact is not None else clauses


class LineIndex:
    """Postings of the patterns' trigrams over the lines of a block of records."""

    def __init__(self, patterns: dict[str, str]) -> None:
        self.clauses = {name: required(p) for name, p in patterns.items()}
        for name, c in self.clauses.items():
            if c is None:
                raise ValueError(f"pattern {name} requires no trigram")
        grams = sorted({g for c in self.clauses.values() for x in c for g in x if g.isascii()})
        if len(grams) > 1000:
            raise ValueError("more than 1000 trigrams")
        self.number = {g: k for k, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for g, k in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = k + 1

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, dict[int, list[str]]]]:
        """For each record with any: its place and by line number (from 0) the patterns whose postings meet there."""
        blobs = [t.encode("utf-8", "replace") for t in texts]
        joined = b"\n".join(blobs)
        raw = np.frombuffer(joined.lower(), dtype=np.uint8)
        if len(raw) < 3:
            return
        code = raw[:-2].astype(np.uint32)
        code <<= 8
        code |= raw[1:-1]
        code <<= 8
        code |= raw[2:]
        gram = self.table[code]
        at = np.flatnonzero(gram)
        if not len(at):
            return
        breaks = np.flatnonzero(raw == 10)
        line = np.searchsorted(breaks, at)
        pair = np.unique(line.astype(np.int64) * 1024 + gram[at] - 1)
        line, gram = pair >> 10, pair & 1023
        lines, row = np.unique(line, return_inverse=True)
        held = np.zeros((len(lines), len(self.number)), dtype=bool)
        held[row, gram] = True
        starts = np.cumsum([0] + [len(b) + 1 for b in blobs[:-1]])
        first_line = np.searchsorted(breaks, starts)
        record = np.searchsorted(first_line, lines, side="right") - 1
        found: dict[int, dict[int, list[str]]] = {}
        for name, clauses in self.clauses.items():
            hit = np.zeros(len(lines), dtype=bool)
            for c in clauses:
                cols = [self.number[g] for g in c if g in self.number]
                hit |= held[:, cols].all(axis=1)
            for k in np.flatnonzero(hit):
                r = int(record[k])
                found.setdefault(r, {}).setdefault(int(lines[k] - first_line[r]), []).append(name)
        yield from sorted(found.items())


def matches(pattern: str, text: str) -> bool:
    """Whether the required trigrams let `text` through; every match does."""
    clauses = required(pattern)
    low = text.lower()
    return clauses is None or any(all(g in low for g in c) for c in clauses)


def compiled(patterns: dict[str, str]) -> dict[str, re.Pattern]:
    return {k: re.compile(p) for k, p in patterns.items()}
