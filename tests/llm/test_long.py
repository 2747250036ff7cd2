"""Long and hostile inputs end in reasonable time."""

import random
import time

import pytest

from gnomon.llm import abuse, docpairs, folding, leaks, origin, secrets, validity

RND = random.Random(1)
BLOB = "".join(RND.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=400_000))
TEXTS = {
    "one word": "a" * 400_000, "accented word": "é" * 400_000, "blob with names": "key" + BLOB + "password" + BLOB, "blanks": " " * 400_000, "signs": "://:" * 100_000, "quotes": "'\"" * 100_000, "dots": "a." * 200_000,
    "stars": "*" * 300_000, "numbers": "1, " * 150_000, "url run": "://" + "a:" * 150_000, "minified": "function a(b){return b?1:2};" * 12_000, "lines": "password = x\n" * 20_000, "names": "pass_" * 80_000, "mixed scripts": "aж" * 100_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_long_texts(name):
    text = TEXTS[name]
    for f in (
        lambda: list(secrets.Finder().blocks([text, f"x = '{text[:200_000]}'"])), lambda: abuse.Lexicon().events(text), lambda: leaks.words(text), lambda: folding.latin(text),
        lambda: (origin.marked(text.split("\n")), origin.layout("a.py", text, text.split("\n")), origin.layout("a.js", text, text.split("\n"))),
        lambda: docpairs.python_doc(text), lambda: docpairs.informs(text, "f", ""), lambda: docpairs.javascript_pairs(text), lambda: validity.verdict("javascript", text), lambda: validity.verdict("toml", text[:50_000]),
    ):
        t = time.perf_counter()
        f()
        assert time.perf_counter() - t < 8, name


def test_deep_nesting():
    assert validity.verdict("javascript", "(" * 3000 + "1" + ")" * 3000) == "ok"
    assert validity.verdict("javascript", "(" * 100_000) == validity.NOT_JUDGED
    assert validity.verdict("javascript", "x = " + "[" * 15_000 + "]" * 15_000) == "ok" and validity.verdict("javascript", "{" * 5000 + "}" * 4999) == "corrupt"
    assert validity.verdict("json", "[" * 20_000 + "]" * 20_000) == "ok" and validity.verdict("json", "[" * 20_000 + "]" * 19_999) == "corrupt"
    assert validity.verdict("json", '{"a": ' * 30_000 + "[]" + "}" * 30_000) == "ok" and validity.verdict("json", '{"a": ' * 30_000 + "}" * 30_000) == "corrupt"
    assert validity.verdict("python", "(" * 300 + ")" * 300) == validity.NOT_JUDGED and validity.verdict("python", "x = " + "-" * 100_000 + "1") == validity.NOT_JUDGED
    assert validity.verdict("javascript", "x = " + "a ? b : " * 1500 + "c;") == "ok"
    assert validity.verdict("javascript", "if (a) b(); " + "else if (c) d(); " * 1500) == "ok"
    assert docpairs.python_doc("def f(a=" + "(" * 5000 + ")" * 5000 + "): pass") in ((None, None), ("f", None))
