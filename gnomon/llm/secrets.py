"""Credentials in source code and configuration.

Each detector is a regular expression.  The trigrams it requires are derived from it; an index
of lines by those trigrams is built for every block of records in the task that holds it (the
index is partitioned like the files, so nothing is shuffled), postings are intersected, and a
detector's expression runs on its candidate lines only.  What an expression finds is then judged:
placeholders, masked values, references to a store or the environment, ids and checksums are no
secrets.  Literals joined by `+` or by standing on following lines (any number of them, with `+` or
a backslash at either side, comments between) are read as one before the rules run, encoded ones
(base64, hexadecimal, reversed) are decoded.

Defined results: null and empty contents have no findings and stay as they are; repeated rows give
their findings once (found) or once per row (redact); a null id is kept as null; an empty table
gives empty results; a record of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm.trigrams import LineIndex, compiled

BLOCK_CHARS = 1_000_000  # of text indexed at a time
MARK = "REDACTED"
LONG = 200  # characters from which on words of placeholders occur in keys by chance

_NAME = (
    r"pass(?:word|wd|phrase|wort|code|_?key)?|passwort|kennwort|senha|clave|contrase(?:n|ñ)a|mot_?de_?passe|geheimnis|pwd|secret|token|api_?key|apikey|"
    r"access_?key|auth(?:orization)?|cred(?:ential)?s?|private_?key|signing_?key|master_?key|encryption_?key|_key|jwt|bearer|login"
)
#: Detection expressions.  Formats that are secrets by themselves, then places that hold one.
FORMATS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "github_pat": r"github_pat_[A-Za-z0-9_]{40,}",
    "gitlab": r"glpat-[A-Za-z0-9_\-]{18,}",
    "slack": r"xox[abeoprs]-[0-9A-Za-z\-]{20,}",
    "aws_id": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "google": r"AIza[0-9A-Za-z_\-]{30,}",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,}",
    "sk": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_\-]{20,}",
    "jwt": r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}",
    "npm": r"npm_[A-Za-z0-9]{36}",
    "pypi": r"pypi-[A-Za-z0-9_\-]{50,}",
    "sendgrid": r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    "account_key": r"AccountKey=(?P<v>[A-Za-z0-9+/]{40,}={0,2})",
    "shared_key": r"SharedAccessKey=(?P<v>[A-Za-z0-9+/]{30,}={0,2})",
    "hook": r"/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/(?P<v>[A-Za-z0-9]{16,})",
    "discord": r"/api/webhooks/\d{10,}/(?P<v>[A-Za-z0-9_\-]{40,})",
}
PLACES = {
    "pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "url": r"://(?P<u>[^\s/:@\"'<>{}]*):(?P<v>(?:(?!://)[^\s@\"'{}<>])*)@(?=[\w\[])",
    "assign": rf"(?i)(?:{_NAME}|[_\-]pw|pw[ =:]).*",
    "sshpass": r"sshpass\s+-p\s*(?P<v>[^\s\"']+)",
    "curl": r"curl\s(?:.*\s)?(?:-u|--user)[ =]?(?P<u>[^\s:\"']+):(?P<v>[^\s\"']+)",
    "mysql": r"mysql(?:dump|admin)?\s.*-p(?P<v>[^\s\"'\-][^\s\"']*)",
    "netrc": r"machine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>[^\s\"']+)",
    "flag": r"--(?:password|passwd|pass|token|secret|api-?key)[= ](?P<v>[^\s\"',]+)",
    "basic": r"(?i)basic\s+(?P<v>[A-Za-z0-9+/]{8,}={0,2})",
    "bearer": r"(?i)bearer\s+(?P<v>[A-Za-z0-9_\-.~+/]{16,}=*)",
    "told": r"(?i)(?:login|log in|sign in|account|user)\b.*",
    "joined": r"[\"'] \+ [\"']",
    "decoded": r"(?i)(?:b64decode|fromhex|unhexlify|atob|buffer\.from)\(\s*b?[\"'](?P<v>[A-Za-z0-9+/=_\-]{12,})[\"']",
}
PATTERNS = {**FORMATS, **PLACES}

_REFERENCE = re.compile(r"(?i)^(?:vault|env|ssm|secrets?|file|arn|op|keyring|kms|aws|gcp|azure|sops|projects|prod|dev|staging|stage|test|config|settings|ref|k8s)[:/.]")
_PLACEHOLDER = re.compile(
    r"(?i)your|change.?me|replace|redact|example|placeholder|dummy|insert|enter.|todo|fixme|xxxx|\*\*\*|\.\.\.|<|>|\{|\}|\$\(|%\(|^%s|none$|null$|undefined|not.?set|here$|secret.?name|fake|sample|masked|hidden|removed|•"
)
_NOT_A_SECRET_NAME = re.compile(
    r"(?i)(?:_|-|\b)(?:env|names?|path|file|dir|url|uri|min|max|length|len|ttl|seconds|size|count|limit|hash|digest|sha\d*|md5|field|header|label|type|kind|policy|regex|pattern|prefix|suffix|schema|public|pub|csrf_field|column|format|algorithm|expiry|expires|timeout|hint|prompt|message|help|title|placeholder|store|manager|ref|author|authors|version)(?:_|-|\d|$)|public|author(?!iz)|tokeniz|tokens?_(?:per|count|limit)"
)
_NAMED = re.compile(rf"(?i)(?:^|[^a-z]|(?<=[a-z])(?=[A-Z]))(?:{_NAME}|pw)(?![a-z])|(?:password|passwd|passwort|passphrase|secret|token|apikey|api_key)s?(?![a-z])")
#: A name of any length and what stands between it and its value.
_GIVEN = re.compile(r"(?<![\w\-.])[\-.]*+(?P<name>[A-Za-z_][\w\-.]*+)(?P<mid>[\"'\]]*\s*(?:(?::=|=>|=|,)\s*|:\s*(?:[A-Za-z_][\w\[\]. |]*=\s*)?))")
_TOLD = re.compile(r":\s*[\w.\-@]+\s*/\s*(?P<v>[^\s\"']{8,})")
_LOGIN = re.compile(r"(?i)(?:login|log in|sign in|account|user)\b")
_STRING = re.compile(r"[rbuRBU]?[fF]?(?P<q>\"\"\"|'''|\"|'|`)(?P<v>(?:\\.|(?!(?P=q)).)*)(?P=q)")
_JOIN = re.compile(r"[\"']\s*\+\s*[\"']")
_REMARK = r"[ \t]*(?:(?:\#|//)[^\n]*)?\r?\n"
#: From the end of a literal to the beginning of the next one on a later line, or a literal that goes on after a backslash.
_OVER = re.compile(
    rf"""(?<!"")(?<!'')["'][ \t]*+(?:\+[ \t]*+)?\\?{_REMARK}(?:{_REMARK})*+[ \t]*(?:\+[ \t]*)?[rRbBuUfF]{{0,2}}["'](?!""|'')|`[ \t]*\+{_REMARK}(?:{_REMARK})*+[ \t]*["'`]|["'`]{_REMARK}(?:{_REMARK})*+[ \t]*\+[ \t]*["'`]"""
    r"""|(?<=[A-Za-z0-9+/=_\-])\\\r?\n(?=[A-Za-z0-9+/=_\-]+["'\\])"""
)
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|;|<!--)")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_BODY = re.compile(r"[A-Za-z0-9+/=]{24,}")
_LINE_END = re.compile(r"(?:\\+r)?\\+n|\r?\n")
#: A line of a private key: what may stand before and after the digits in code, comments and quotations; headers of the block.
_KEY_LINE = re.compile(r"""(?:[\s"'`,;()\[\]\#*>|\\]|[+/]+(?=[\s"'`])|-(?=\s)|[rbuRBUfF]{1,2}(?=["'`]))*+(?P<v>(?:[A-Za-z0-9+/=]|\\+/)*+(?:\s+(?:[A-Za-z0-9+/=]|\\+/){24,}+)*+(?:\s+[A-Za-z0-9+/]{4,23}={0,2})?)(?:[\s"'`,;()\[\]*|\\]|\+(?=\s|$))*+$""")
_KEY_HEADER = re.compile(r"""[\s"'`+#*>|/]*(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID|Content-Domain|Key-ID|[A-Z][A-Za-z]*-[A-Z][A-Za-z\-]*): """)


def _varied(v: str) -> bool:
    return len(set(v)) >= min(6, len(v) - 1)


def _dense(v: str) -> bool:
    """Whether a value has only signs of encoded keys and is mixed like one (words of placeholders occur in it by chance)."""
    if not re.fullmatch(r"[A-Za-z0-9+/=_\-.]+", v):
        return False
    share = [n / len(v) for n in Counter(v).values()]
    return -sum(p * math.log2(p) for p in share) >= (3.5 if _HEX.match(v) else 4.5)


def _material(line: str) -> bool:
    """Whether a line of a private key reads like its digits, not like words that stand for them."""
    if len(line) < 24:  # the end of the digits
        return not re.search(r"(?i)your|here|key|\.\.|xxx", line) and bool(re.search(r"[\d+/=]|[a-z][A-Z]", line))
    return all(re.search(p, line) for p in (r"[a-z]", r"[A-Z]", r"\d")) and len(set(line)) >= 12


def opaque(v: str, least: int = 8) -> bool:
    """Whether a value reads like a password or key that works as it stands."""
    if len(v) < least or re.search(r"\s", v) or not _varied(v):
        return False
    if len(v) >= LONG and _dense(v):
        return True
    if _PLACEHOLDER.search(v) or _REFERENCE.search(v) or v[0] in "$%@" and re.match(r"^[$%@][A-Za-z_{(][\w})]*$", v):
        return False
    if re.match(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$", v) and sum(c.isdigit() for c in v) < 3:
        return False  # the name of a variable
    if re.match(r"^[a-z_.\-/: ]+$|^[A-Z_.\-]+$|^[A-Z]?[a-z]+$|^[\d.,:\-]+$", v):
        return False  # words, constants, numbers
    if re.match(r"^[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?$", v) and len(v) < 32 and not re.search(r"\d{3}", v):
        return False  # an attribute of something
    mixed = len(v) >= 30 and all(re.search(p, v) for p in (r"\d", r"[A-Z]", r"[a-z]"))
    if re.match(r"^https?://[^:@]*$|^\w+\(", v) or re.match(r"^[.~]*/[\w./\-]+$", v) and not mixed:
        return False
    return _kinds(v) >= 2


def _kinds(v: str) -> int:
    """How many of lower case, upper case, digits and signs a value has."""
    return sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def _decode(v: str) -> str:
    """The text behind base64 or hexadecimal digits, or nothing."""
    try:
        if _HEX.match(v) and len(v) % 2 == 0:
            raw = bytes.fromhex(v)
        else:
            raw = base64.b64decode(v.replace("-", "+").replace("_", "/") + "=" * (-len(v) % 4), validate=True)
        text = raw.decode("ascii")
    except (ValueError, binascii.Error, UnicodeDecodeError):
        return ""
    return text if re.sub(r"[\r\n\t]", "", text).isprintable() else ""


class Finder:
    """Findings of a text; one per task."""

    def __init__(self) -> None:
        self.index = LineIndex(PATTERNS)
        self.rules = compiled(PATTERNS)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, list[tuple[int, int, str]]]]]]:
        """(place, findings) of each text that has any; a finding is (line from 1, spans of the text to replace)."""
        at = 0
        while at < len(texts):
            block, size, first = [], 0, at
            while at < len(texts) and (not block or size < BLOCK_CHARS):
                block.append(texts[at] or "")
                size += len(block[-1])
                at += 1
            candidates = dict(self.index.candidates(block))
            for place, text in enumerate(block):
                if (place in candidates or _OVER.search(text)) and (found := self.judge(text, candidates.get(place, {}))):
                    yield first + place, found

    def judge(self, text: str, candidates: dict[int, list[str]]) -> list[tuple[int, list[tuple[int, int, str]]]]:
        lines = text.split("\n")
        starts = [0]
        for x in lines[:-1]:
            starts.append(starts[-1] + len(x) + 1)
        out: list[tuple[int, list[tuple[int, int, str]]]] = []
        keys: list[tuple[int, int, int, int]] = []  # first and last line, first and last character of each private key
        for no in sorted(no for no, names in candidates.items() if "pem" in names):
            if keys and no <= keys[-1][1]:
                continue
            for m in self.rules["pem"].finditer(lines[no]):
                if (not keys or starts[no] + m.start() >= keys[-1][3]) and (got := self.pem(text, starts[no], starts[no] + m.end())):
                    keys.append((no, bisect_right(starts, got[1] - 1) - 1, starts[no] + m.start(), got[1]))
                    out.append((no + 1, got[0]))
        inside = {no for a, b, _, _ in keys for no in range(a + 1, b)}
        last: dict[int, int] = {}  # of the lines on which joined literals begin: the line on which they end
        begin = -1
        for m in _OVER.finditer(text):
            a, b = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end()) - 1
            begin = begin if begin >= 0 and last[begin] == a else a
            last[begin] = b
        # a value may stand on the line after its name
        after = {no + 1 for no, names in candidates.items() if "assign" in names and lines[no].rstrip()[-1:] in ("(", "=", "\\") and no + 1 < len(lines)}
        taken: list[tuple[int, int]] = []  # what the joined literals held, in order
        for no in sorted(after | set(candidates) | set(last)):
            ways = []  # (joined, whether it may lie in what the joined literals held, findings)
            if no in last:
                ways.append((True, True, self.line(lines, starts, no, last[no], [])))
            if (no in candidates or no in after) and no not in inside:  # statements that only look like one literal; comments between
                names = candidates.get(no, [])
                ways.append((False, False, self.line(lines, starts, no, no, names)))
                if no not in last and (own := [k for k in names if k in FORMATS]):
                    ways.append((False, True, self.line(lines, starts, no, no, own)))
            for joined, anywhere, way in ways:
                for spans in way:
                    if any(self.meets(keys, s[0], s[1]) for s in spans) or not anywhere and any(self.meets(taken, s[0], s[1]) for s in spans):
                        continue
                    out.append((bisect_right(starts, spans[0][0]), spans))
                    if joined:
                        taken += [s[:2] for s in spans]
        merged: dict[int, list[tuple[int, int, str]]] = {}
        for no, spans in out:
            merged.setdefault(no, []).extend(spans)
        return sorted((no, list(dict.fromkeys(spans))) for no, spans in merged.items())

    @staticmethod
    def pem(text: str, start: int, begin: int) -> tuple[list[tuple[int, int, str]], int] | None:
        """(spans, end) of the body of the private key whose BEGIN ends at `begin`, on its line (from `start`, with escaped line ends) or on those that follow.

        The body goes on as long as the lines look like key material.  Where no END closes it, a
        line shorter than those before is its last one and has to look like digits of a key.
        """
        at = begin
        owner = re.match(r"\s*([\w.]+)", text[start:begin].partition("-----")[0])
        cores: list[tuple[int, int]] = []
        end, closed = begin, False
        while at <= len(text) and not closed:
            e = _LINE_END.search(text, at)
            stop = e.start() if e else len(text)
            mark = text.find("-----END", at, stop)
            closed = mark >= 0
            part = text[at : mark if closed else stop]
            k = _KEY_LINE.match(part)
            if k is None and owner and part.lstrip().startswith(owner[1]):  # the same variable or call again
                q = re.search(r"[\"'`]", part)
                k = q and _KEY_LINE.match(part, q.start())
            if k is None and not _KEY_HEADER.match(part):
                closed = False
                break
            if k and k["v"]:
                cores.append((at + k.start("v"), at + k.end("v")))
                end = cores[-1][1]
            if closed:
                end = mark + 8
                tail = re.compile(r"[A-Z0-9 ]*-----").match(text, end)
                end = tail.end() if tail else end
            elif e is None:
                break
            at = e.end() if e else len(text)
        if not closed:
            width = next((b - a for a, b in cores if b - a >= 24), 0)
            n = 0
            while n < len(cores) and cores[n][1] - cores[n][0] >= width:
                n += 1
            if n < len(cores):
                v = text[slice(*cores[n])]
                n += bool(re.search(r"[\d+/=]|[a-z][A-Z]", v)) and len(v) >= 4
            cores = cores[:n]
            end = cores[-1][1] if cores else begin
        lines = [text[a:b] for a, b in cores]
        if not _BODY.search(text[begin:end]) or not any(map(_material, lines)) or any(_PLACEHOLDER.search(x) for x in lines if not _material(x)):
            return None
        return [(a, b, "" if k else MARK) for k, (a, b) in enumerate(cores)], end

    def line(self, lines: list[str], starts: list[int], no: int, last: int, names: list[str]) -> Iterator[list[tuple[int, int, str]]]:
        """The spans of each secret on a line, or on the lines up to `last` that joined literals take."""
        line = lines[no]
        spots: list[int] | None = None  # place in the text of each character, where literals were joined
        text = line
        if last > no:
            text, spots = self.without(re.compile(f"{_OVER.pattern}|{_JOIN.pattern}"), "\n".join(lines[no : last + 1]))
        elif _JOIN.search(line):
            text, spots = self.without(_JOIN, line)
        if spots is not None:
            names = list(PATTERNS)
        found: list[tuple[int, int]] = []
        for name in names:
            for m in self.rules[name].finditer(text):
                found += self.accept(name, m, text, line)
        if not found and no and lines[no - 1].rstrip()[-1:] in ("(", "=", "\\"):
            before = lines[no - 1].rstrip().rstrip("\\").rstrip()
            found += self.accept_value(before, text)
        for a, b in self.merged(found):
            yield self.pieces(starts[no], text, a, b, spots)

    @staticmethod
    def meets(rows: list[tuple], a: int, b: int) -> bool:
        """Whether one of the rows, which rise, do not overlap and end in (first, end), has a character of a..b."""
        k = bisect_left(rows, b, key=lambda row: row[-2])
        return k > 0 and rows[k - 1][-1] > a

    @staticmethod
    def without(cut: re.Pattern, line: str) -> tuple[str, list[int]]:
        out, spots, at = [], [], 0
        for m in cut.finditer(line):
            out.append(line[at : m.start()])
            spots += range(at, m.start())
            at = m.end()
        out.append(line[at:])
        spots += range(at, len(line))
        return "".join(out), spots

    @staticmethod
    def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    @staticmethod
    def pieces(start: int, text: str, a: int, b: int, spots: list[int] | None) -> list[tuple[int, int, str]]:
        """Spans of the original text; what stands in several literals is replaced in the first and emptied in the rest."""
        mark = base64.b64encode(MARK.encode()).decode() if re.search(r"(?i)b64decode\(\s*b?[\"']$|atob\([\"']$|basic\s+$", text[:a]) else MARK
        if re.search(r"(?i)(?:fromhex|unhexlify)\(\s*b?[\"']$", text[:a]):
            mark = MARK.encode().hex()
        if spots is None:
            return [(start + a, start + b, mark)]
        out, k = [], a
        while k < b:
            e = k
            while e + 1 < b and spots[e + 1] == spots[e] + 1:
                e += 1
            out.append((start + spots[k], start + spots[e] + 1, mark if k == a else ""))
            k = e + 1
        return out

    @staticmethod
    def named(name: str) -> bool:
        return bool(_NAMED.search(name)) and not _NOT_A_SECRET_NAME.search(name)

    def holds_key(self, plain: str) -> bool:
        """Whether a decoded text holds a private key."""
        return any(self.pem(plain, plain.rfind("\n", 0, m.start()) + 1, m.end()) for m in self.rules["pem"].finditer(plain))

    def accept_value(self, before: str, text: str) -> list[tuple[int, int]]:
        """A literal whose name stands on the line before."""
        s = _STRING.search(text)
        if s and text[: s.start()].strip() in ("", "b", "r") and opaque(s["v"]) and any(self.named(m["name"]) for m in _GIVEN.finditer(before + ' ""')):
            return [(s.start("v"), s.end("v"))]
        return []

    def accept(self, name: str, m: re.Match, text: str, line: str) -> list[tuple[int, int]]:
        if name == "joined" or name == "pem":
            return []
        if name in FORMATS:
            part = "v" if "v" in m.re.groupindex else 0
            v = m[part]
            bare = re.sub(r"(?i)^[a-z]+[_\-]", "", v)
            if "EXAMPLE" in v or not _varied(bare) or re.search(r"(?i)x{6}|your|redacted|placeholder", v) or (name == "sk" and not re.search(r"\d", v)):
                return []
            return [m.span(part)]
        if name == "url":
            v = m["v"]
            return [m.span("v")] if len(v) >= 6 and opaque(v, 6) and v.lower() not in ("password", "pass") else []
        if name == "basic":
            plain = _decode(m["v"])
            return [m.span("v")] if ":" in plain and opaque(plain.partition(":")[2], 4) else []
        if name == "decoded":
            plain = _decode(m["v"])
            if any(r.search(plain) for k, r in self.rules.items() if k in FORMATS) or "://" in plain and self.rules["url"].search(plain) or self.holds_key(plain):
                return [m.span("v")]
            if (re.search(r"\d", plain) or len(plain) >= 16) and opaque(plain):
                return [m.span("v")]
            return []
        if name in ("sshpass", "curl", "mysql", "netrc", "flag", "bearer"):
            return [m.span("v")] if opaque(m["v"], 16 if name == "bearer" else 6) else []
        if name == "told":
            found = []
            for t in _TOLD.finditer(text, m.start()):
                v = t["v"]
                before = text[max(m.start(), text.rfind(":", 0, t.start()) + 1) : t.start()]  # up to the colon before
                if _LOGIN.search(before) and (_kinds(v) >= 3 or re.search(r"\d", v)) and opaque(v, 6):
                    found.append(t.span("v"))
            return found
        return self.assigned(m, text, line)

    def assigned(self, m: re.Match, text: str, line: str) -> list[tuple[int, int]]:
        """The value a telling name is given."""
        out: list[tuple[int, int]] = []
        for n in _GIVEN.finditer(text):  # every named place of the line
            name = n["name"]
            if not self.named(name) or ("," in n["mid"] and not n["mid"].strip()[:1] in "\"'"):
                continue
            at = n.end()
            rest = text[at:]
            s = _STRING.match(rest.lstrip("( "))
            if s:
                pad = len(rest) - len(rest.lstrip("( "))
                a, b = at + pad + s.start("v"), at + pad + s.end("v")
                v = s["v"]
                scheme = re.match(r"(?i)(?:bearer|basic|token|apikey)\s+", v)
                if scheme:
                    v, a = v[scheme.end() :], a + scheme.end()
                    if scheme[0].lower().startswith("basic"):
                        continue  # judged by its own detector
                after = text[at + pad + s.end() :]
                if re.match(r"\s*\[::-1\]", after):
                    v = v[::-1]
                if re.match(r"\s*%|\s*\.format\(", after) or (s[0][:1] in "fF" and "{" in v):
                    continue
                if self.value(name, v):
                    out.append((a, b))
                continue
            e = re.match(r"(?:os\.)?(?:environ\.get|getenv|environ\.setdefault|env|config|get)\(\s*[\"'][^\"']*[\"']\s*(?:,\s*(?:default\s*=\s*)?|\)\s*(?:or|\?\?|\|\|)\s*)", rest) or re.match(
                r"(?:process\.env[.\[\w\"'\]]+|import\.meta\.env\.\w+|os\.environ\[[^\]]*\]|[\w.]+)\s*(?:\|\||\?\?|or)\s*", rest
            )
            if e and (s := _STRING.match(rest[e.end() :])):
                if self.value(name, s["v"]):
                    out.append((at + e.end() + s.start("v"), at + e.end() + s.end("v")))
                continue
            d = re.match(r"[\w.]*(?:b64decode|fromhex|unhexlify|atob|from)\(\s*b?[\"'](?P<v>[A-Za-z0-9+/=_\-]{8,})[\"']", rest)
            if d:
                plain = _decode(d["v"])
                if plain and (opaque(plain) or self.holds_key(plain)):
                    out.append((at + d.start("v"), at + d.end("v")))
                continue
            r = re.match(r"(?:\"\"\.join\(\s*)?(?:reversed\(\s*)?[\"'](?P<v>[^\"']{8,})[\"']", rest)
            if r and "join" in rest[:12] and self.value(name, r["v"][::-1]):
                out.append((at + r.start("v"), at + r.end("v")))
                continue
            if _COMMENT.match(line) and "," not in n["mid"]:
                b = re.match(r"(?P<v>[^\s\"'(),;]{8,})(?=\s|$|\))", rest)
                if b and self.value(name, b["v"]) and re.search(r"\d", b["v"]):
                    out.append((at, at + b.end("v")))
        return out

    @staticmethod
    def value(name: str, v: str) -> bool:
        if _UUID.match(v) and not re.search(r"(?i)key|token|secret|pass", name):
            return False
        if not opaque(v):
            # lower-case letters alone, but no words: long runs of consonants
            return bool(re.search(r"(?i)pass|pwd|_pw|senha|clave|secret", name) and re.match(r"^[a-z]{12,}$", v) and re.search(r"[^aeiou]{5}", v) and not _PLACEHOLDER.search(v))
        weak = re.search(r"(?i)_key$|^auth|login|session|jwt", name) and not re.search(r"(?i)api|access|secret|sign|master|encr|private", name)
        return not weak or bool(re.search(r"\d", v)) or len(v) >= 16 or _kinds(v) >= 3


def found(records: DataFrame, kind: str, id_col: str, text_col: str = "content") -> DataFrame:
    """(record_kind, record_id, line_no), distinct."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            ids = pdf["record_id"].tolist()
            rows = [(ids[k], no) for k, lines in finder.blocks(pdf["content"].tolist()) for no, _ in lines]
            yield pd.DataFrame(rows, columns=["record_id", "line_no"])

    out = _records(records, id_col, text_col).mapInPandas(run, "record_id string, line_no int").distinct()
    return out.select(F.lit(kind).alias("record_kind"), F.col("record_id").cast("long").alias("record_id"), "line_no")


def _records(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids travel as strings: a column of integers with nulls would become floating point."""
    return records.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("content")).where(F.col("content") != "")


def redact(records: DataFrame, kind: str, id_col: str, text_col: str = "content") -> DataFrame:
    """(record_kind, record_id, secrets, content) of the records with a secret, the secrets replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            ids, texts, rows = pdf["record_id"].tolist(), pdf["content"].tolist(), []
            for k, lines in finder.blocks(texts):
                rows.append((ids[k], len(lines), replaced(texts[k], [s for _, spans in lines for s in spans])))
            yield pd.DataFrame(rows, columns=["record_id", "secrets", "content"])

    out = _records(records, id_col, text_col).mapInPandas(run, "record_id string, secrets int, content string")
    return out.select(F.lit(kind).alias("record_kind"), F.col("record_id").cast("long").alias("record_id"), "secrets", "content")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, mark in sorted(spans):
        if a < at:
            if b <= at:
                continue
            a, mark = at, ""
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]
