"""Abusive, hateful and sexual content in texts.

The weighted lexicon of `lexicon` is matched by Aho-Corasick automata over folded words: look-alike
letters, invisible characters, digits for letters, letters spaced or dotted apart, masked, doubled
or swapped letters are brought back to the lexicon's words first.  Scripts without blanks between
words go through an automaton over folded letters.  Some entries stand for themselves; others
count in company only (insults aimed at somebody, degrading words said of a group, violence that
somebody intends).  Entries within the sentence of an exception phrase (rules, tests, reports,
medicine, talk about oneself) count for nothing.  The score is the weight per hundred words.

Defined results: null, empty and blank texts score 0 and are not flagged; every row gives one
score, repeated rows repeated ones; a null source is a source of its own in the rates; an empty
table gives empty results; other columns are ignored; a text of any length is read whole, in time
that grows with its length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import lexicon
from gnomon.llm.folding import latin
from gnomon.session import spread

#: Digits and signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})
_PART = regex.compile(r"[\p{L}\p{N}@$!*#+€|']+")
_LETTERS = regex.compile(r"^\p{L}+$")
_DOTTED = regex.compile(r"^\W*(?:(?:\w[.\-_·]){2,}\w?|(?:\w\*){2,}\w)\W*$")
_ENDS = regex.compile(r"[.?!;:…。！？]\W*$")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー]+")
_WIDE_ENDS = regex.compile(r"[。！？!?；]+")
#: Everyday words of the lexicon's phrases: no disguise is taken for one of these.
COMMON = frozenset("""
your with been they them that this have want will would should than then were what when from into here there their some every free desk come came body like back make more most over under better best rock near live lose brain brains hire deserve deserves people same rights
take takes took taking down never must need needs hope wish family kids children mother father wife husband house world everyone project down send sent keep kept drive driven throw thrown ruin ruins bring place among country village region faith race caste religion these those that kind sort folks guys
men women woman girls boys natives poles roma turks smarter faster cleverer brighter write code think trusted hired allowed stop fire fired ban all let why only does doesnt dont cant wont just face neck head legs arms chest back lips teeth nose jaw bones skull sleep room love like video videos clips pics photos pictures
tape show chat cam action girls waiting hard night off out one nobody loves likes wants needs cares about asked opinion review computer keyboard terminal repository author developer person human programmer coder engineer reviewer space breath time failure pile sack disgrace team grade born same human wet black brown asian indian
old poor foreign blind deaf religious dog cat rock brick break hurt hunt bury skin burn beat hang crush shoot slap touch touched touching grab rub bite stroke kiss great nice nicer bend strip ride dance light lazy dirty pack animals disease by nature birth blood too to be as not""".split())
SHORT = frozenset("sex rot ass fag die tit".split())
_RUNS = regex.compile(r"(.)\1+")


def _key(word: str) -> str:
    """The letters without order or doubling."""
    return "".join(sorted(set(word)))


def _slip(typed: str, meant: str) -> bool:
    """Whether `typed` is `meant` with letters doubled or two neighbours swapped."""
    if _RUNS.sub(r"\1", typed) == _RUNS.sub(r"\1", meant):
        return True
    off = [k for k, (a, b) in enumerate(zip(typed, meant, strict=False)) if a != b]
    return len(typed) == len(meant) and len(off) == 2 and off[1] == off[0] + 1 and typed[off[0]] == meant[off[1]] and typed[off[1]] == meant[off[0]]


class Lexicon:
    """The automata and the lookup of disguised words; one per task."""

    def __init__(self) -> None:
        content: dict[str, None] = {}  # in the order of the lexicon, which decides what a masked word means first
        by_phrase: dict[str, dict[str, float]] = defaultdict(dict)
        by_wide: dict[str, dict[str, float]] = defaultdict(dict)
        for kind, weight, phrase in lexicon.phrases():
            phrase = latin(phrase)
            if _WIDE.search(phrase):
                by_wide[phrase.replace(" ", "")][kind] = weight
                continue
            kinds = by_phrase[phrase]
            kinds[kind] = max(weight, kinds.get(kind, 0.0))
            if kind == "target" and phrase not in lexicon.LOOSE_TARGETS:
                kinds["near target"] = 0.0
            if weight:
                content.update(dict.fromkeys(phrase.split()))
        self.longest = max(p.count(" ") + 1 for p in by_phrase)
        self.trie, self.wide = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, kinds in by_phrase.items():
            self.trie.add_word(f" {phrase} ", (tuple(kinds.items()), phrase.count(" ") + 1))
        for phrase, kinds in by_wide.items():
            self.wide.add_word(phrase, (tuple(kinds.items()), len(phrase)))
        self.trie.make_automaton()
        self.wide.make_automaton()
        self.words = {w for w in content if len(w) > 2}
        self.keys: dict[str, list[str]] = defaultdict(list)
        self.masked: dict[tuple[str, str, int], list[str]] = defaultdict(list)
        for w in (x for x in content if x not in COMMON and (len(x) > 3 or x in SHORT)):
            self.keys[_key(w)].append(w)
            self.masked[w[0], w[-1], len(w)].append(w)
        self.known: dict[str, str] = {}
        self.raws: dict[str, tuple[str, tuple[str, ...], bool]] = {}

    def word(self, raw: str) -> str:
        """The lexicon's word for a disguised one, else the word itself."""
        got = self.known.get(raw)
        if got is None:
            got = self._word(raw)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[raw] = got
        return got

    def _word(self, raw: str) -> str:
        w = raw.replace("'", "")
        if w in self.words:
            return w
        if "*" in w or "#" in w:
            bare = w.rstrip("!")
            if len(bare) >= 3 and bare[0].isalpha() and bare[-1].isalpha():
                return "|".join(self.masked.get((bare[0], bare[-1], len(bare)), ()))
            return regex.sub(r"[*#]", "", w)
        for v in (w, w.rstrip("!|+")):
            if not _LETTERS.match(v):
                v = v.translate(SIGNS)
            if v in self.words:
                return v
            if len(v) >= 3 and _LETTERS.match(v):
                for meant in self.keys.get(_key(v), ()):
                    if _slip(v, meant):
                        return meant
        return w.rstrip("!|+").translate(SIGNS) if not w.isdigit() else w

    def token(self, raw: str) -> tuple[str, tuple[str, ...], bool]:
        """(the letter of a token that is one letter, the words of any other, whether a sentence ends)."""
        if _DOTTED.match(raw):
            return "", (self.word(regex.sub(r"[\W_]", "", raw)),), bool(_ENDS.search(raw))
        parts = _PART.findall(raw)
        if len(parts) == 1 and len(parts[0].rstrip("!")) == 1:
            return parts[0][0], (), False
        return "", tuple(self.word(p) for p in parts), bool(_ENDS.search(raw))

    def stream(self, text: str) -> tuple[list[str], list[int], dict[int, list[str]]]:
        """Words, the number of each one's sentence, and by sentence the letters of scripts without blanks."""
        out: list[str] = []
        sentence: list[int] = []
        wide: dict[int, list[str]] = {}
        at = 0
        single: list[str] = []

        def flush() -> None:
            if len(single) >= 3:
                joined = "".join(single).translate(SIGNS)
                for k in range(2):
                    if self.word(joined[k:]) in self.words:
                        joined = joined[k:]
                        break
                out.append(self.word(joined))
                sentence.append(at)
            else:
                for x in single:
                    out.append(x)
                    sentence.append(at)
            single.clear()

        folded = latin(text)
        any_wide = _WIDE.search(folded) is not None
        for line in folded.split("\n"):
            for raw in line.split():
                if any_wide and _WIDE.search(raw):
                    for k, part in enumerate(_WIDE_ENDS.split(raw)):
                        at += bool(k)
                        if letters := _WIDE.findall(part):
                            wide.setdefault(at, []).extend(letters)
                        for w in _PART.findall(_WIDE.sub(" ", part)):
                            out.append(self.word(w))
                            sentence.append(at)
                    continue
                got = self.raws.get(raw)
                if got is None:
                    if len(self.raws) > 500_000:
                        self.raws.clear()
                    got = self.raws[raw] = self.token(raw)
                letter, ready, ends = got
                if letter:
                    single.append(letter)
                    continue
                if single:
                    flush()
                for w in ready:
                    out.append(w)
                    sentence.append(at)
                if ends:
                    at += 1
            if single:
                flush()
            at += 1
        return out, sentence, wide

    def events(self, text: str) -> tuple[float, int, int]:
        """(weight, events, words) of a text."""
        words, sentence, wide = self.stream(text)
        first = [w.partition("|")[0] for w in words]
        spots: dict[str, list[tuple[int, int, float]]] = defaultdict(list)
        self.scan(first, 0, len(first), spots)
        for k, w in enumerate(words):
            if "|" in w:  # a masked word may stand for several: the others are read with the words around it
                low, high = max(0, k - self.longest), min(len(words), k + self.longest + 1)
                for other in w.split("|")[1:]:
                    self.scan([*first[low:k], other, *first[k + 1 : high]], low, high, spots, k)
        void = {sentence[x] for a, b, _ in spots.pop("exception", ()) for x in (a, b)}
        marks = self.marks({kind: [x for x in found if sentence[x[0]] not in void and sentence[x[1]] not in void] for kind, found in spots.items()})
        weight, events, letters = sum(marks.values()), len(marks), 0
        for at, parts in wide.items():
            joined = "".join(parts)
            letters += len(joined)
            found = [(end, kind, w, n) for end, (kinds, n) in self.wide.iter(joined) for kind, w in kinds]
            if at in void or any(kind == "exception" for _, kind, _, _ in found):
                continue
            reach = -1
            for end, _, w, n in found:
                if end - n >= reach:  # of overlapping entries the first
                    weight, events, reach = weight + w, events + 1, end
        return weight, events, len(words) + (letters + 1) // 2

    def scan(self, words: list[str], low: int, high: int, spots: dict[str, list[tuple[int, int, float]]], through: int = -1) -> None:
        """Adds (first word, last word, weight) by kind of every entry in the words, which are the text's from `low` on; only those over `through`, if it is given."""
        joined, starts, at = [" "], {}, 1
        for k, w in enumerate(words):
            starts[at] = low + k
            joined.append(w + " ")
            at += len(w) + 1
        hay = "".join(joined)
        for end, (kinds, n) in self.trie.iter(hay):
            # the pattern's blanks: its last word ends before `end`
            last = starts.get(hay.rfind(" ", 0, end) + 1)
            if last is None or through >= 0 and not last - n < through <= last:
                continue
            for kind, weight in kinds:
                spots[kind].append((last - n + 1, last, weight))

    @staticmethod
    def marks(spots: dict[str, list[tuple[int, int, float]]]) -> dict[int, float]:
        """The places where something abusive begins, with the weight of what begins there."""
        begins = {kind: sorted({a for a, _, _ in found}) for kind, found in spots.items()}

        def near(kind: str, low: int, high: int, own: int) -> bool:
            all_of = begins.get(kind, [])
            k = bisect_left(all_of, low)
            while k < len(all_of) and all_of[k] <= high:
                if all_of[k] != own:
                    return True
                k += 1
            return False

        marks: dict[int, float] = {}
        for kind, company in lexicon.RULES:
            for a, b, weight in spots.get(kind, ()):
                if all(near(other, a - before, b + after, a) == wanted for other, before, after, wanted in company):
                    marks[a] = max(weight, marks.get(a, 0.0))
        return marks


def scores(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text_col: str = "text") -> DataFrame:
    """`keep` with score (weight per hundred words), events and flagged, a row for each row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        for pdf in batches:
            rows = [lexicon.events(t) if t else (0.0, 0, 0) for t in pdf["_text"]]
            out = pdf[names].copy()
            out["score"] = [100.0 * w / max(n, 1) for w, _, n in rows]
            out["events"] = [e for _, e, _ in rows]
            out["flagged"] = [e > 0 for _, e, _ in rows]
            yield out

    schema = ", ".join(f"`{n}` {fields[n]}" for n in names) + ", score double, events int, flagged boolean"
    return spread(docs.select(*names, F.col(text_col).alias("_text"))).mapInPandas(run, schema)


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Documents, flagged ones, their share and the mean score per value of `by`."""
    return scored.groupBy(by).agg(
        F.count("*").alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"),
        F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"),
    )
