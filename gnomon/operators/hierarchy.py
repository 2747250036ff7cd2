"""Parent-child links to full hierarchies: components, loops, paths, descendants.

The work runs in stages, each over the whole table:

1. `forest`: weighted disjoint sets.  Every task joins the links it holds into local trees,
   keeping for each node the offset to the local root (a child lies one below its parent).
   Nodes seen by several tasks become links between local roots, and these are merged level
   by level with ever fewer tasks.  A link whose two ends are already joined with another
   offset is a conflict; a component without one has no loop.
2. Components up to `local_links` links are each brought into one task, which indexes the
   links by child and by parent, looks for loops where the component has a conflict, and walks
   the paths down from the roots.
3. Larger components stay spread: `loops` searches those with a conflict by distributed
   colouring, and `paths` doubles upward segments each round by a join on the segment's top
   node, so a hierarchy of depth d takes log2(d) joins.  The two ways give the same rows.
4. `closure` joins pairs of nodes, not paths: a round doubles the distance it knows, so the work
   grows with the pairs however many paths lead from one to the other.

Defined results for odd rows: a null child or parent makes no link (the other name is still a
node); repeated links count once; a null group is a group of its own; an empty name is a name
like any other; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gnomon.session import cut

CYCLE, BELOW, JOIN = "(cycle)", "(below cycle)", " > "
MOST_HUBS = 100_000  # that are broadcast


def node_id(group: Column, name: Column) -> Column:
    """128 bits for a node; a null group differs from every named one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("g"), group.cast("string")), F.lit("n")), F.lit("\x00"), name).cast("binary")))


def links_of(edges: DataFrame, group: str, child: str, parent: str) -> DataFrame:
    """Distinct links (g, c, p, cid, pid)."""
    e = edges.select(F.col(group).alias("g"), F.col(child).alias("c"), F.col(parent).alias("p"))
    e = e.where(F.col("c").isNotNull() & F.col("p").isNotNull()).distinct()
    return e.withColumns({"cid": node_id(F.col("g"), F.col("c")), "pid": node_id(F.col("g"), F.col("p"))})


def nodes_of(edges: DataFrame, group: str, child: str, parent: str) -> DataFrame:
    """Distinct nodes (g, name)."""
    names = edges.select(F.col(group).alias("g"), F.explode(F.array(F.col(child), F.col(parent))).alias("name"))
    return names.where(F.col("name").isNotNull()).distinct()


class WeightedSets:
    """Disjoint sets whose members know their offset to the root."""

    def __init__(self) -> None:
        self.up: dict[Any, tuple[Any, int]] = {}
        self.size: dict[Any, int] = {}
        self.conflicts: set = set()

    def find(self, x: Any) -> tuple[Any, int]:
        if x not in self.up:
            self.up[x] = (x, 0)
            self.size[x] = 1
            return x, 0
        trail, total = [], 0
        while self.up[x][0] != x:
            trail.append(x)
            x = self.up[x][0]
        for y in reversed(trail):  # nearest to the root first
            total += self.up[y][1]
            self.up[y] = (x, total)
        return x, total

    def join(self, a: Any, b: Any, w: int) -> None:
        """a lies w below b."""
        (ra, oa), (rb, ob) = self.find(a), self.find(b)
        if ra == rb:
            if oa != ob + w:
                self.conflicts.add(ra)
            return
        shift = ob + w - oa  # offset of ra against rb
        if self.size[ra] > self.size[rb]:
            ra, rb, shift = rb, ra, -shift
        self.up[ra] = (rb, shift)
        self.size[rb] += self.size[ra]
        if ra in self.conflicts:
            self.conflicts.add(rb)


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = WeightedSets()
    for pdf in batches:
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"], strict=True):
            sets.join(a, b, int(w))
    members = list(sets.up)
    for at in range(0, len(members), 50_000):
        rows = []
        for v in members[at : at + 50_000]:
            root, off = sets.find(v)
            rows.append((v, root, off, root in sets.conflicts))
        yield pd.DataFrame(rows, columns=["v", "root", "off", "conflict"])


def forest(links: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """(v, root, off, conflict) for every end of `links` (a, b, w: a lies w below b).

    Links are spread by the end that comes first in a hash order of the level, so a task
    joins whole stars and every level leaves fewer roots than the one before.  The star of a node
    with more than `rows_per_task` links is split over as many tasks as it takes; the pieces
    meet at that node on the next level.
    """
    levels: list[DataFrame] = []
    now, count, level = links, links.count(), 0
    while True:
        parts = max(1, math.ceil(count / rows_per_task))
        if parts > 1:
            ha, hb = (F.xxhash64(F.lit(level), F.col(x)) for x in "ab")
            now = now.withColumns({"key": F.when(ha < hb, F.col("a")).otherwise(F.col("b")), "end": F.when(ha < hb, hb).otherwise(ha)})
            hubs = cut(now.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task))
            few = hubs.count()  # at most count / rows_per_task
            piece = F.lit(0)
            if few:
                now = now.join(F.broadcast(hubs) if few <= MOST_HUBS else hubs, "key", "left")
                piece = F.when(F.col("n").isNotNull(), F.pmod("end", F.ceil(F.col("n") / rows_per_task))).otherwise(0)
            now = now.repartition(parts, "key", piece).select("a", "b", "w")
        else:
            now = now.coalesce(1)
        local = cut(now.mapInPandas(_local_forest, "v binary, root binary, off long, conflict boolean"))
        if parts == 1:
            levels.append(local)
            break
        seen = local.withColumn("first", F.min(F.struct("root", "off")).over(Window.partitionBy("v")))
        same = F.col("root") == F.col("first.root")
        clash = same & (F.col("off") != F.col("first.off"))
        levels.append(
            seen.groupBy("v").agg(F.first("first.root").alias("root"), F.first("first.off").alias("off"), F.max(F.col("conflict") | clash).alias("conflict"))
        )
        # off(root) + off == off(first.root) + first.off for the one node both describe
        now = cut(seen.where(~same).select(F.col("root").alias("a"), F.col("first.root").alias("b"), (F.col("first.off") - F.col("off")).alias("w")).distinct())
        count, level = now.count(), level + 1
        if not count:
            break
    out = levels[0]
    for nxt in levels[1:]:
        up = nxt.select(F.col("v").alias("root"), F.col("root").alias("r2"), F.col("off").alias("o2"), F.col("conflict").alias("k2"))
        out = out.join(up, "root", "left").select(
            "v", F.coalesce("r2", "root").alias("root"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), (F.col("conflict") | F.coalesce("k2", F.lit(False))).alias("conflict")
        )
    if len(levels) > 1:  # a conflict found anywhere holds for the whole component
        bad = out.where("conflict").select("root").distinct().withColumn("k", F.lit(True))
        out = out.join(bad, "root", "left").select("v", "root", "off", F.coalesce("k", F.lit(False)).alias("conflict"))
        out = cut(out)
    return out


def _components(parents: dict[str, list[str]]) -> set[str]:
    """Nodes on a loop."""
    return {v for ring in _rings(parents) for v in ring}


def _rings(parents: dict[str, list[str]]) -> list[list[str]]:
    """The strongly connected sets that hold a loop, by an iterative walk."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    found: list[list[str]] = []
    for start in parents:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        work = [(start, iter(parents[start]))]
        while work:
            v, rest = work[-1]
            for u in rest:
                if u not in order:
                    order[u] = low[u] = len(order)
                    stack.append(u)
                    on.add(u)
                    work.append((u, iter(parents.get(u, ()))))
                    break
                if u in on:
                    low[v] = min(low[v], order[u])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    group = []
                    while True:
                        u = stack.pop()
                        on.discard(u)
                        group.append(u)
                        if u == v:
                            break
                    if len(group) > 1 or v in parents.get(v, ()):
                        found.append(group)
    return found


def _below(loop: set[str], children: dict[str, list[str]]) -> set[str]:
    below, todo = set(), list(loop)
    while todo:
        for c in children.get(todo.pop(), ()):
            if c not in loop and c not in below:
                below.add(c)
                todo.append(c)
    return below


def _walk(rows: list[tuple[str, str]], conflict: bool) -> Iterator[tuple[str, str, list[str]]]:
    """(node, root or state, names from the root) of one component's links (child, parent)."""
    parents: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    for c, p in rows:
        parents.setdefault(c, []).append(p)
        children.setdefault(p, []).append(c)
    loop = _components(parents) if conflict else set()
    below = _below(loop, children) if loop else set()
    for v in loop:
        yield v, CYCLE, []
    for v in below:
        yield v, BELOW, []
    bad = loop | below
    for root in children:
        if root in parents or root in bad:
            continue
        way, todo = [root], [iter(children[root])]
        while todo:
            c = next(todo[-1], None)
            if c is None:
                todo.pop()
                way.pop()
            elif c not in bad:
                way.append(c)
                yield c, root, list(way)
                todo.append(iter(children.get(c, ())))


def _local_hierarchy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component; each component is walked when its last row is in."""
    columns = ["g", "name", "root", "names"]
    out: list[tuple] = []
    now, rows, conflict, group = None, [], False, None

    def done() -> Iterator[tuple]:
        seen: set[tuple[str, str]] = set()
        for node, root, names in _walk(rows, conflict):
            if any(JOIN in n for n in names):  # such names can make two ways look alike
                if (node, JOIN.join(names)) in seen:
                    continue
                seen.add((node, JOIN.join(names)))
            yield group, node, root, names

    for pdf in batches:
        for root, g, c, p, k in zip(pdf["root"], pdf["g"], pdf["c"], pdf["p"], pdf["conflict"], strict=True):
            if root != now:
                for row in done():
                    out.append(row)
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                now, rows, conflict, group = root, [], bool(k), g
            rows.append((c, p))
    for row in done():
        out.append(row)
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _spread(links: DataFrame, start: DataFrame, src: str, dst: str) -> DataFrame:
    """All (v) reachable from `start` (v) along links src -> dst, `start` included."""
    seen, front = start, start
    while True:
        step = links.join(front.withColumnRenamed("v", src), src).select(F.col(dst).alias("v")).distinct()
        front = cut(step.join(seen, "v", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def _coloured_loops(links: DataFrame) -> DataFrame:
    """(v, state, ring) for links of any size: forward colours, then backward within a colour."""
    loops = links.where("cid = pid").select(F.col("cid").alias("v"), F.col("cid").alias("ring"))
    rest = cut(links.where("cid <> pid").select("cid", "pid"))
    while not rest.isEmpty():
        # trim nodes that have no link on one side; they are on no loop
        while True:
            kept = rest.join(rest.select(F.col("pid").alias("cid")).distinct(), "cid", "left_semi")
            kept = cut(kept.join(kept.select(F.col("cid").alias("pid")).distinct(), "pid", "left_semi"))
            before, after = rest.count(), kept.count()
            rest = kept
            if before == after:
                break
        if not after:
            break
        colour = cut(rest.select(F.col("cid").alias("v")).distinct().withColumn("k", F.col("v")))
        while True:  # the greatest node above or at each node
            up = rest.join(colour.withColumnRenamed("v", "pid"), "pid").groupBy(F.col("cid").alias("v")).agg(F.max("k").alias("u"))
            nxt = cut(colour.join(up, "v", "left").select("v", F.greatest("k", F.coalesce("u", "k")).alias("k"), (F.col("u") > F.col("k")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            colour = nxt.select("v", "k")
            if not moved:
                break
        a = colour.select(F.col("v").alias("cid"), F.col("k").alias("kc"))
        b = colour.select(F.col("v").alias("pid"), F.col("k").alias("kp"))
        inside = cut(rest.join(a, "cid").join(b, "pid").where("kc = kp").select("cid", "pid", F.col("kc").alias("ring")))
        found = _spread(inside, colour.where("v = k").select("v"), "cid", "pid")
        ends = inside.join(found.withColumnRenamed("v", "cid"), "cid", "left_semi").join(found.withColumnRenamed("v", "pid"), "pid", "left_semi")
        loops = loops.unionByName(ends.select(F.explode(F.array("cid", "pid")).alias("v"), "ring"))
        gone = found
        rest = cut(rest.join(gone.withColumnRenamed("v", "cid"), "cid", "left_anti").join(gone.withColumnRenamed("v", "pid"), "pid", "left_anti"))
    loops = cut(loops.groupBy("v").agg(F.max("ring").alias("ring")))  # a node that is its own parent may be on a larger loop too
    below = _spread(links, loops.select("v"), "pid", "cid").join(loops, "v", "left_anti")
    below = below.select("v", F.lit(BELOW).alias("state"), F.lit(None).cast("binary").alias("ring"))
    return loops.select("v", F.lit(CYCLE).alias("state"), "ring").unionByName(below)


def _local_loops(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component's nodes that are on a loop or below one."""
    parents: dict[str, list[str]] = {}
    children: dict[str, list[str]] = {}
    for c, p in zip(pdf["cid"], pdf["pid"], strict=True):
        parents.setdefault(c, []).append(p)
        children.setdefault(p, []).append(c)
    rings = _rings(parents)
    rows = [(v, CYCLE, max(ring)) for ring in rings for v in ring] + [(v, BELOW, None) for v in _below({v for ring in rings for v in ring}, children)]
    return pd.DataFrame(rows, columns=["v", "state", "ring"])


def loops(links: DataFrame, sets: DataFrame, local_links: int = 200_000) -> DataFrame:
    """(v, state, ring) of the nodes on a loop or below one; all others are absent.

    `ring` is the greatest id of the node's strongly connected set, null below the loops.
    `links` has cid and pid, `sets` is what `forest` gave.  Components with more than
    `local_links` links are never brought into one task.
    """
    marked = cut(links.select("cid", "pid").join(sets.where("conflict").select(F.col("v").alias("cid"), "root"), "cid"))
    sizes = marked.groupBy("root").agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > local_links).select("root"))
    if large.isEmpty():
        return marked.groupBy("root").applyInPandas(_local_loops, "v binary, state string, ring binary")
    out = marked.join(large, "root", "left_anti").groupBy("root").applyInPandas(_local_loops, "v binary, state string, ring binary")
    return out.unionByName(_coloured_loops(cut(marked.join(large, "root", "left_semi").select("cid", "pid"))))


def paths(links: DataFrame, state: DataFrame) -> DataFrame:
    """(g, name, root, names): each distinct path of a node that is neither on nor below a loop.

    `names` runs from the root to the node; roots themselves are not listed.
    """
    clean = links.join(state.select(F.col("v").alias("cid")), "cid", "left_anti")
    inner = clean.select(F.col("g").alias("tg"), F.col("c").alias("top")).distinct().withColumn("more", F.lit(True))
    ends = F.col("g").eqNullSafe(F.col("tg"))

    def marked(seg: DataFrame) -> DataFrame:
        return seg.join(inner.withColumnRenamed("top", "t2"), ends & (F.col("top") == F.col("t2")), "left").select(
            "g", "name", "top", "names", F.coalesce("more", F.lit(False)).alias("more")
        )

    seg = cut(marked(clean.select("g", F.col("c").alias("name"), F.col("p").alias("top"), F.array("p", "c").alias("names"))))
    done = []
    while True:
        done.append(seg.where("not more").select("g", "name", "top", "names"))
        still = seg.where("more")
        if still.isEmpty():
            break
        # a segment's top is the node of the segments it goes on with
        up = reduce(DataFrame.unionByName, [d.withColumn("more", F.lit(False)) for d in done]).unionByName(still)
        up = up.select(F.col("g").alias("tg"), F.col("name").alias("mid"), F.col("top").alias("top2"), F.col("names").alias("upper"), F.col("more").alias("more2"))
        seg = cut(
            still.join(up, ends & (F.col("top") == F.col("mid"))).select(
                "g", "name", F.col("top2").alias("top"), F.concat("upper", F.expr("slice(names, 2, size(names))")).alias("names"), F.col("more2").alias("more")
            )
        )
    return reduce(DataFrame.unionByName, done).withColumnRenamed("top", "root")


def closure(links: DataFrame) -> DataFrame:
    """(a, d, depth): every two different nodes with a way of links (cid below pid) from a down to d, and the least number of links.

    With all pairs up to a distance k known, those of up to 2k are a pair at exactly k and one that
    begins where it ends.  Loops end by themselves, as a pair that is known is not taken again.
    """
    known = cut(links.where("cid <> pid").select(F.col("pid").alias("a"), F.col("cid").alias("d"), F.lit(1).alias("depth")).distinct())
    k = 1
    while True:
        far = known.where(F.col("depth") == k).select("a", F.col("d").alias("mid"))
        on = known.select(F.col("a").alias("mid"), "d", "depth")
        longer = far.join(on, "mid").where("a <> d").groupBy("a", "d").agg((F.min("depth") + k).alias("depth"))
        new = cut(longer.join(known, ["a", "d"], "left_anti"))
        if new.isEmpty():
            return known
        known, k = cut(known.unionByName(new)), 2 * k


@dataclass
class Hierarchy:
    """Frames over one edge table: nodes (g, name), links and weighted sets; the rest is found when it is asked for."""

    nodes: DataFrame
    links: DataFrame
    sets: DataFrame
    local_links: int

    @cached_property
    def found(self) -> DataFrame:
        """(g, name, root, names), a row per path; for a node on or below a loop root is the state and names is empty; roots themselves are not listed."""
        links, sets = self.links, self.sets
        placed = cut(links.join(sets.select(F.col("v").alias("cid"), "root", "conflict"), "cid"))
        sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
        large = cut(sizes.where(F.col("size") > self.local_links).select("root"))
        kind = links.schema["g"].dataType.simpleString()
        if large.isEmpty():
            small, rest = placed, None
        else:
            small, rest = placed.join(large, "root", "left_anti"), cut(placed.join(large, "root", "left_semi"))
        small = small.select("root", "g", "c", "p", "conflict").repartition("root").sortWithinPartitions("root")
        found = small.mapInPandas(_local_hierarchy, f"g {kind}, name string, root string, names array<string>")
        if rest is not None:
            left = rest.select("g", "c", "p", "cid", "pid")
            state = cut(loops(left, sets, self.local_links))
            bad = _named(left).join(state, "v").select("g", "name", F.col("state").alias("root"), F.array().cast("array<string>").alias("names"))
            long_ways = paths(left, state).withColumn("_path", F.array_join("names", JOIN)).dropDuplicates(["g", "name", "_path"]).select("g", "name", "root", "names")
            found = found.unionByName(bad).unionByName(long_ways)
        return found

    def table(self) -> DataFrame:
        """(g, name, root, depth, path): a row per path, roots and loop nodes included."""
        own = self.nodes.withColumn("v", node_id(F.col("g"), F.col("name")))
        linked = self.links.select(F.col("cid").alias("v")).distinct()
        roots = own.join(linked, "v", "left_anti").select("g", "name", F.col("name").alias("root"), F.lit(0).alias("depth"), F.col("name").alias("path"))
        loop = F.size("names") == 0
        full = self.found.select("g", "name", "root", F.when(loop, -1).otherwise(F.size("names") - 1).alias("depth"), F.when(loop, F.col("root")).otherwise(F.array_join("names", JOIN)).alias("path"))
        return roots.unionByName(full)

    def descendants(self) -> DataFrame:
        """(g, ancestor, descendant, depth): every two nodes with a way down from one to the other, and the shortest.

        Nodes of one loop are no descendants of each other (`table` reports the loop); what lies
        below a loop descends from its nodes and from all above it.
        """
        pairs = closure(self.links)
        if not self.sets.where("conflict").isEmpty():  # there may be loops
            pairs = pairs.join(pairs.select(F.col("d").alias("a"), F.col("a").alias("d")), ["a", "d"], "left_anti")
        names = _named(self.links)
        above = names.select(F.col("v").alias("a"), "g", F.col("name").alias("ancestor"))
        below = names.select(F.col("v").alias("d"), F.col("name").alias("descendant"))
        return pairs.join(above, "a").join(below, "d").select("g", "ancestor", "descendant", "depth")

    def components(self) -> DataFrame:
        """(g, root name of the weighted set, members, span of levels, conflict)."""
        own = self.nodes.withColumn("v", node_id(F.col("g"), F.col("name")))
        full = own.join(self.sets, "v")
        return full.groupBy("root").agg(
            F.first("g").alias("g"), F.min("name").alias("first_name"), F.count("*").alias("members"), (F.max("off") - F.min("off") + 1).alias("levels"), F.max("conflict").alias("conflict")
        )


def _named(links: DataFrame) -> DataFrame:
    """(g, v, name) of the ends of links."""
    ends = F.array(F.struct(F.col("cid").alias("v"), F.col("c").alias("name")), F.struct(F.col("pid").alias("v"), F.col("p").alias("name")))
    return links.select("g", F.explode(ends).alias("x")).select("g", "x.*").distinct()


def build(
    edges: DataFrame, group: str = "repo", child: str = "class_qualified_name", parent: str = "base_qualified_name", rows_per_task: int = 200_000, local_links: int = 200_000
) -> Hierarchy:
    """The hierarchies of an edge table; see the module's text for odd rows."""
    links = cut(links_of(edges, group, child, parent))
    sets = forest(links.select(F.col("cid").alias("a"), F.col("pid").alias("b"), F.lit(1).cast("long").alias("w")), rows_per_task)
    return Hierarchy(nodes_of(edges, group, child, parent), links, sets, local_links)
