import random

import pytest

from gnomon.llm import bpe, leaks

DOCS = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def odd_texts():
    rnd = random.Random(7)
    out = ["", " ", "\n\n  x", "a" * 30_000, "ab" * 5000, "<|endoftext|> it's I'LL", "naïve café — “q” … 日本語 ｆｗ ﬁ", "👩‍💻🏳️‍🌈\u200b\x00\x1b[31m", "١٢٣ 4567.89e-3", "\r\n\t\u2028\u3000 end "]
    alphabet = "ab cd\n\té日́0'.,<|>_-"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(150)]
    return out


def test_ids_equal_the_library(tokenizer):
    e = bpe.Encoder(bpe.read_ranks(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.tiktoken"))
    texts = odd_texts()
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode(text) == want.ids


def test_round_trip():
    ranks = bpe.read_ranks(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.tiktoken")
    back = {v: k for k, v in ranks.items()}
    for text in odd_texts():
        assert b"".join(back[i] for i in bpe.Encoder(ranks).encode(text)).decode() == text


def test_rank_queue_orders_ranks():
    rnd = random.Random(1)
    q, model = bpe.RankQueue(), {}
    for _ in range(3000):
        if rnd.random() < 0.6 or not model:
            r, at = rnd.randrange(50_257), rnd.randrange(1000)
            q.push(r, at)
            model.setdefault(r, []).append(at)
        else:
            r = min(model)
            assert q.first() == r and q.take(r) == model.pop(r)


def test_encode_table(spark):
    rows = [(1, "hello world", "a", "x"), (1, "hello world", "a", "x"), (2, None, None, None), (3, "", "", ""), (None, "hi", "b", "y")]
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [5303])], key=str)
    assert bpe.encode(spark.createDataFrame([], DOCS)).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


NOUNS = "ledger anvil turbine meadow silo crate harbor kiln pulley rivet loom barge ferry locker".split()


def items():
    rnd = random.Random(5)
    head = "Answer the question about this repository in one short paragraph ."
    return {k: head + " " + " ".join(f"{rnd.choice(NOUNS)}{rnd.randrange(60)} {rnd.choice('sorts weighs drains locks counts'.split())} {rnd.choice(NOUNS)}" for _ in range(30)) for k in range(1, 13)}


def cases():
    rnd = random.Random(9)
    it = items()
    fill = "The parser gives up at line 9 and the whole file is left out . We agreed on that last week already ."
    w = {k: v.split() for k, v in it.items()}
    docs = {
        1: f"{fill} {it[1]} {fill}", 2: fill + " " + it[2].upper().replace(" ", "  \n> "), 3: fill + " " + " ".join(w[3][40:80]) + " " + fill,
        4: " ".join(rnd.choice(["roughly", "also"]) if rnd.random() < 0.12 else x for x in w[4]), 5: " ".join(w[5][:11]) + " " + fill, 6: " ".join(w[6][30:38]) + " " + fill, 7: fill, 8: None, 9: "  ",
        10: it[7] + " " + fill * 40 + " " + it[8], 11: "".join(x[0] + x[1:].replace("e", "е") + " " for x in w[9]),
    }
    return it, docs, {(1, 1), (2, 2), (3, 3), (4, 4), (10, 7), (10, 8), (11, 9)}


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_leaks(spark, seeds):
    it, docs, want = cases()
    d = spark.createDataFrame([(k, t, "s", "i") for k, t in docs.items()] * 2 + [(None, it[1], "s", "i")], DOCS)
    i = spark.createDataFrame([(k, "suite", t) for k, t in it.items()] + [(90, "s", None), (91, "s", ""), (92, "s", "too short"), (None, "s", it[3])], "item_id long, suite string, text string")
    rows = [tuple(r) for r in leaks.leaks(d, i, in_task_chars=seeds).select("doc_id", "item_id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert leaks.leaks(d.limit(0), i, in_task_chars=seeds).count() == 0
    assert leaks.leaks(d, i.limit(0), in_task_chars=seeds).count() == 0


def test_alignment_against_plain_recursion():
    rnd = random.Random(3)
    for _ in range(40):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))]
        b = [rnd.choice("abcde") for _ in range(rnd.randrange(1, 9))]
        best = 0.0
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(1, len(a) + 1):
            for y in range(1, len(b) + 1):
                h[x][y] = max(0, h[x - 1][y - 1] + (leaks.MATCH if a[x - 1] == b[y - 1] else leaks.MISMATCH), h[x - 1][y] + leaks.GAP, h[x][y - 1] + leaks.GAP)
                best = max(best, h[x][y])
        pairs = leaks.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and (best > 0) == bool(pairs)
        score, last = 0.0, None
        for i, j in pairs:
            if last:
                di, dj = i - last[0] - 1, j - last[1] - 1
                score += leaks.MISMATCH * min(di, dj) + leaks.GAP * abs(di - dj)
            score, last = score + leaks.MATCH, (i, j)
        assert abs(score - best) < 1e-9


ITEMS = "item_id long, suite string, text string"


def both_ways(spark, docs, its):
    d = spark.createDataFrame([(k, t, "s", "i") for k, t in docs.items()], DOCS)
    i = spark.createDataFrame([(k, "suite", t) for k, t in its.items()], ITEMS)
    one, two = (leaks.leaks(d, i, in_task_chars=n).cache() for n in (10**9, 0))
    rows = [{tuple(r) for r in x.collect()} for x in (one, two)]
    assert rows[0] == rows[1]
    return {tuple(r) for r in leaks.found(one).collect()}, {(r["doc_id"], r["item_id"]): r["within"] for r in one.collect()}


def test_items_of_one_text_and_variants(spark):
    """Neither several ids of a text nor near-equal items hide a leak; each id is reported."""
    it = items()
    fill = "We agreed on that last week already , and nobody minds . "
    w = it[2].split()
    its = {**it, 21: it[1], 22: it[1].upper(), 31: " ".join([*w[:50], "pontoon", *w[51:]]), 32: " ".join([*w[:70], "gondola", *w[71:]])}
    got, _ = both_ways(spark, {1: fill + it[1] + fill, 2: fill + it[2], 3: fill}, its)
    assert got == {(1, 1), (1, 21), (1, 22), (2, 2), (2, 31), (2, 32)}


def test_items_that_lie_in_longer_ones(spark):
    it = items()
    w = it[3].split()
    its = {**it, 40: it[3] + " " + it[5], 41: " ".join(w[20:50] + it[7].split()[30:]) }
    got, within = both_ways(spark, {1: "so it is . " + it[3] + " " + it[5] + " and so on", 2: it[3]}, its)
    assert {(1, 40), (1, 3), (1, 5), (2, 3)} <= got and within[1, 3] == 40 and within[1, 40] is None
    assert (1, 41) not in got and within.get((1, 41), 40) is not None  # a third of it, in the passage of another item


def long_item(n, seed):
    rnd = random.Random(seed)
    return [f"{rnd.choice(NOUNS)}{rnd.randrange(4000)}" for _ in range(n)]


def test_long_items_both_ways(spark):
    """Items of 20 000 words, whole, edited, in part, twice in a document."""
    a, b = long_item(20_000, 1), long_item(3000, 2)
    rnd = random.Random(3)
    edited = [x if rnd.random() > 0.1 else "word" for x in b]
    docs = {1: " ".join(a), 2: "x " * 500 + " ".join(edited) + " y" * 500, 3: " ".join(a[4000:11_000]), 4: " ".join(b) + " z" * 9000 + " ".join(b[:2000]), 5: " ".join(b[:100])}
    got, _ = both_ways(spark, docs, {1: " ".join(a), 2: " ".join(b)})
    assert got == {(1, 1), (2, 2), (3, 1), (4, 2)}


def test_alignment_in_bounded_memory():
    import tracemalloc

    a = long_item(20_000, 1)
    doc = ["x"] * 20_000 + a + ["y"] * 20_000
    tracemalloc.start()
    pairs = leaks.align(a, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == [(k, 20_000 + k) for k in range(20_000)] and peak < 400_000_000
    rnd = random.Random(4)
    for _ in range(60):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randrange(1, 40))] for _ in range(2))
        assert leaks.align(x, y, 3) == leaks.align(x, y, 1000) == leaks.align(x, y, 1)


def test_stretches_hold_every_passage():
    rnd = random.Random(5)
    for _ in range(50):
        at = sorted(rnd.sample(range(3000), rnd.randrange(1, 400)))
        reach = rnd.randrange(5, 300)
        got = list(leaks.stretches(at, reach))
        assert all(b - a <= 2 * reach for a, b in got)
        for x in at:
            inside = [y for y in at if x <= y <= x + reach]
            assert any(a <= x and inside[-1] <= b for a, b in got if a <= x <= b) or at[at.index(inside[-1]) :] == [] or max(inside[k + 1] - inside[k] for k in range(len(inside) - 1)) > reach
