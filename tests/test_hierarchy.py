import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gnomon.operators import hierarchy as H

SCHEMA = "repo string, class_qualified_name string, base_name string, base_qualified_name string, name string"


def brute(rows):
    """(group, node, root, depth, path) by walking every path."""
    parents, nodes = defaultdict(set), set()
    for g, c, p in rows:
        for x in (c, p):
            if x is not None:
                nodes.add((g, x))
        if c is not None and p is not None:
            parents[(g, c)].add((g, p))

    def above(n):
        seen, todo = set(), list(parents[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    loop = {n for n in nodes if n in above(n)}
    out = set()
    for n in nodes:
        if n in loop:
            out.add((*n, "(cycle)", -1, "(cycle)"))
        elif above(n) & loop:
            out.add((*n, "(below cycle)", -1, "(below cycle)"))
        else:
            todo = [[n[1]]]
            while todo:
                way = todo.pop()
                up = parents[(n[0], way[0])]
                if not up:
                    out.add((*n, way[0], len(way) - 1, " > ".join(way)))
                todo += [[p[1], *way] for p in up]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(g, c, "b", p, "extra") for g, c, p in rows], SCHEMA)
    h = H.build(df, **kw)
    got = [tuple(r) for r in h.table().collect()]
    assert len(got) == len(set(got))
    return set(got), h


CASES = {
    "empty": [],
    "chain": [("r", f"n{i}", f"n{i - 1}") for i in range(1, 40)],
    "loop and below": [("r", "a", "b"), ("r", "b", "a"), ("r", "c", "a"), ("r", "d", "c"), ("r", "e", None), ("r", "d", "x")],
    "own base": [("r", "a", "a"), ("r", "b", "a"), ("r", "c", "x")],
    "diamond of uneven arms": [("r", "d", "b"), ("r", "d", "a"), ("r", "b", "a"), ("r", "e", "d")],
    "between two loops": [("r", "a", "b"), ("r", "b", "a"), ("r", "m", "a"), ("r", "x", "m"), ("r", "x", "y"), ("r", "y", "x")],
    "repeated, nulls, groups": [("r", "a", "b")] * 3 + [("q", "b", "a"), (None, "a", "b"), (None, None, "z"), ("r", None, "b"), ("r", None, None), ("r", "", "b")],
    "names like joined paths": [("r", "d", "a > b"), ("r", "d", "b"), ("r", "b", "a"), ("r", "e", "d")],
    "hub": [("r", f"n{i}", "hub") for i in range(300)] + [("r", "hub", "top")],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    got, _ = run(spark, CASES[name])
    assert got == brute(CASES[name])


@pytest.mark.parametrize("kw", [{"rows_per_task": 7, "local_links": 10**6}, {"rows_per_task": 10**6, "local_links": 0}, {"rows_per_task": 5, "local_links": 0}])
def test_levels_and_colours_agree(spark, kw):
    rnd = random.Random(4)
    rows = [(rnd.choice("pq"), f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(55)]
    rows += [("p", f"k{i}", f"k{i - 1}") for i in range(1, 12)]
    assert run(spark, rows, **kw)[0] == brute(rows)


def brute_pairs(rows):
    """(group, ancestor, descendant, least number of links) of all pairs that are not on one loop."""
    children = defaultdict(set)
    for g, c, p in rows:
        if c is not None and p is not None:
            children[(g, p)].add((g, c))
    dist = {}
    for top in list(children):
        front, k, seen = [top], 0, {top: 0}
        while front:
            k += 1
            front = [c for c in {x for v in front for x in children[v]} if c not in seen]
            seen.update(dict.fromkeys(front, k))
        dist.update({(top, v): n for v, n in seen.items() if v != top})
    return {(a[0], a[1], d[1], n) for (a, d), n in dist.items() if (d, a) not in dist}


def test_descendants(spark):
    """All cases as groups of one table."""
    rows = [(g if g is None else f"{name}/{g}", c, p) for name, case in CASES.items() for g, c, p in case]
    df = spark.createDataFrame([(g, c, "b", p, "extra") for g, c, p in rows], SCHEMA)
    got = [(r["g"], r["ancestor"], r["descendant"], r["depth"]) for r in H.build(df).descendants().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_descendants_below_loops(spark):
    """A keeps B and C though B also inherits from a loop."""
    rows = [("r", "B", "A"), ("r", "C", "B"), ("r", "B", "x"), ("r", "x", "y"), ("r", "y", "x")]
    _, h = run(spark, rows)
    assert {(r["ancestor"], r["descendant"], r["depth"]) for r in h.descendants().collect()} == {("A", "B", 1), ("A", "C", 2), ("B", "C", 1), ("x", "B", 1), ("x", "C", 2), ("y", "B", 2), ("y", "C", 3)}


def test_descendants_of_many_paths(spark):
    """A chain of thirty diamonds has 2^30 paths and some thousand pairs."""
    rows = [("r", f"{side}{i}", f"m{i - 1}") for i in range(1, 31) for side in "ab"] + [("r", f"m{i}", f"{side}{i}") for i in range(1, 31) for side in "ab"]
    df = spark.createDataFrame([(g, c, "b", p, "extra") for g, c, p in rows], SCHEMA)
    got = {(r["g"], r["ancestor"], r["descendant"], r["depth"]) for r in H.build(df).descendants().collect()}
    assert got == brute_pairs(rows)


def test_random_pairs(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("pq"), f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(60)]
    _, h = run(spark, rows)
    assert {(r["g"], r["ancestor"], r["descendant"], r["depth"]) for r in h.descendants().collect()} == brute_pairs(rows)


def test_a_skewed_table_by_both_ways(spark):
    """A hub with a third of the links, a deep chain, uneven trees and loops: tasks of any size and either way give the same rows."""
    from pyspark.sql import functions as F

    rnd = random.Random(7)
    rows = [("r", f"leaf{i}", "hub") for i in range(12_000)] + [("r", "hub", "top")] + [("r", f"c{i}", f"c{i - 1}") for i in range(1, 60)] + [("r", "hub", "c3")]
    rows += [(f"g{k}", f"n{i}", f"n{rnd.randrange(max(1, i // 3 + 1))}") for k in range(60) for i in range(1, 350)]
    rows += [(f"g{k}", f"n{rnd.randrange(20)}", f"n{rnd.randrange(300)}") for k in range(0, 60, 5) for _ in range(2)]
    df = spark.createDataFrame([(g, c, "b", p, "extra") for g, c, p in rows], SCHEMA).cache()
    one = H.build(df).table().select(F.xxhash64("*").alias("h")).groupBy("h").count().cache()
    two = H.build(df, rows_per_task=3000, local_links=1000).table().select(F.xxhash64("*").alias("h")).groupBy("h").count()
    assert one.count() > 30_000 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_hubs_are_split(spark):
    """No task joins a whole star that is larger than its share."""
    from pyspark.sql import functions as F

    links = spark.range(5000).select(F.encode(F.concat(F.lit("n"), "id"), "utf-8").alias("a"), F.encode(F.lit("hub"), "utf-8").alias("b"), F.lit(1).cast("long").alias("w"))
    sets = H.forest(links, rows_per_task=200)
    assert sets.select("root").distinct().count() == 1 and sets.count() == 5001 and sets.where("conflict").isEmpty()
    assert {r[0] for r in sets.groupBy("off").count().collect()} <= {-1, 0, 1} and sets.groupBy("off").count().count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=25))
def test_weighted_sets_find_every_loop(links):
    """A set without a conflict has no loop, and offsets rise by one along each link."""
    sets = H.WeightedSets()
    for c, p in links:
        sets.join(str(c), str(p), 1)
    parents = defaultdict(list)
    for c, p in links:
        parents[str(c)].append(str(p))
    loops = H._components(parents)
    for v in loops:
        assert sets.find(v)[0] in sets.conflicts
    for c, p in links:
        (rc, oc), (rp, op) = sets.find(str(c)), sets.find(str(p))
        assert rc == rp and (oc == op + 1 or rc in sets.conflicts)
