"""Following single needs to their ends, and what that gives: depths and strongly connected components.

Components are looked for within blocks of near names first (objects of one schema need each other): a
block's graph is replaced by what it means for the ways between blocks, and so on with fewer, wider blocks.

A node that needs just one other stands for a step on the way to it.  Such nodes form trees (and
a few rings); jumping pointers find where each one ends in a number of rounds that grows with
the logarithm of the longest chain.  The graph is then rewritten without them, and so on: rounds
grow with branching, not with length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import stored

#: Hops that one round takes.
HOPS = 4
#: Less than this share of the rest isn't worth a round of its own: of edges taken off, or of nodes to fold.
WORTH = 0.1
#: Edges of a block that one task takes; small graphs are cut into blocks of at least ``LEAST_BLOCK``.
BLOCK = 50_000
LEAST_BLOCK = 500


def followed(pointers: DataFrame, combine: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]], longest: int | None = None) -> DataFrame:
    """``pointers (node, to, ...)`` with ``to`` moved to where the way ends, and ``open`` where it doesn't: in or into a ring.

    A node has one pointer.  ``combine`` makes the values of two steps in a row from those of the
    first and of the second.  No way has more than ``longest`` different nodes, if that is known.
    """
    values = [c for c in pointers.columns if c not in ("node", "to")]
    pointers = stored(pointers)
    total, hops = pointers.count(), 1
    if not total:
        return pointers.withColumn("open", F.lit(False))
    total = min(total, longest or total)
    while True:
        step = pointers.select(F.col("node").alias("_node"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in values])
        moved = pointers.select("node", "to", *values)
        for _ in range(HOPS - 1):
            hit = F.col("_node").isNotNull()
            both = combine(F.col, lambda c: F.col(f"_{c}"))
            moved = moved.join(step, F.col("to") == F.col("_node"), "left").select("node", F.coalesce("_to", "to").alias("to"), *[F.when(hit, both[c]).otherwise(F.col(c)).alias(c) for c in values], hit.alias("open"))
        pointers, hops = stored(moved), hops * HOPS
        if hops > total or pointers.where("open").isEmpty():
            return pointers


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def longest_paths(edges: DataFrame) -> DataFrame:
    """``node, depth``: the length of each node's longest path to one that needs nothing; nodes in or above cycles aren't returned.

    A node with one need has depth ``max(low, far + depth of that need)``; two such steps in a row
    are one of the same form, so chains fold.  Nodes with several needs are settled once all are.
    """
    once = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    rest = stored(once.withColumns({"far": F.lit(1).cast("long"), "low": F.lit(0).cast("long")}))
    # Edges carry the greatest depth that settled needs have given their source so far, as ``low``.
    settled = [stored(rest.select(F.col("dst").alias("node")).distinct().join(rest, F.col("node") == F.col("src"), "left_anti").withColumn("depth", F.lit(0).cast("long")))]
    folded: list[DataFrame] = []
    last = None
    while (size := rest.count()) and size != last:
        last = size
        needs = rest.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("to"), F.max("far").alias("far"), F.max("low").alias("low"))
        one = needs.where("n = 1").select(F.col("src").alias("node"), "to", "far", "low")
        if one.count() < WORTH * size:
            one = one.limit(0)
        ends = followed(one, lambda a, b: {"far": a("far") + b("far"), "low": F.greatest(a("low"), a("far") + b("low"))})
        folded.append(ends.where("NOT open"))
        # Edges of nodes with several needs, moved to where those end; low takes in what the way gave.
        via = ends.where("NOT open").select(F.col("node").alias("_via"), F.col("to").alias("_end"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        moved = rest.join(one, rest["src"] == one["node"], "left_anti").join(via, F.col("dst") == F.col("_via"), "left")
        moved = moved.select("src", F.coalesce("_end", "dst").alias("dst"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.greatest("low", F.coalesce(F.col("far") + F.col("_low"), F.lit(0))).alias("low"))
        # What ends at a settled node is a number, not an edge.
        known = _union(settled)
        met = stored(moved.join(known, F.col("dst") == F.col("node"), "left").groupBy("src", F.when(F.col("depth").isNull(), F.col("dst")).alias("dst")).agg(F.max("far").alias("far"), F.max(F.greatest("low", F.coalesce(F.col("far") + F.col("depth"), F.lit(0)))).alias("low")))
        nodes = met.groupBy("src").agg(F.max("low").alias("low"), F.count("dst").alias("n"))
        ready = nodes.where("n = 0").select(F.col("src").alias("node"), F.col("low").alias("depth"))
        ended = ends.where("NOT open").join(known.withColumnRenamed("node", "to"), "to").select("node", F.greatest("low", F.col("far") + F.col("depth")).alias("depth"))
        settled.append(stored(ready.unionByName(ended)))
        # What a fold ended in may be settled only later; such rings and their like stay as edges.
        ringed = rest.join(ends.where("open").select(F.col("node").alias("src")), "src", "left_semi")
        rest = stored(met.where("dst IS NOT NULL").select("src", "dst", "far").join(nodes.select("src", "low"), "src").unionByName(ringed))
    known = _union(settled)
    for fold in reversed(folded):
        late = fold.join(known.select("node"), "node", "left_anti").join(known.withColumnRenamed("node", "to"), "to").select("node", F.greatest("low", F.col("far") + F.col("depth")).alias("depth"))
        known = stored(known.unionByName(late))
    return known


def _coloured(edges: DataFrame, seed: int) -> DataFrame:
    """``node, label``: components of nodes whose first ancestor, in a random order, is in them. Others aren't returned; there is always one that is.

    First names spread forward until nothing changes; backward from each name's own node along
    nodes of that colour are its component.  A random order finds several components of a row of them at once.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    colour = stored(nodes.withColumn("label", F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node").alias("node"))).withColumn("changed", F.lit(True)))
    while not colour.where("changed").isEmpty():
        step = colour
        for _ in range(HOPS):
            news = step.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_new"))
            better = F.coalesce(F.col("_new") < F.col("label"), F.lit(False))
            step = step.join(news, "node", "left").select("node", F.when(better, F.col("_new")).otherwise(F.col("label")).alias("label"), better.alias("changed"))
        colour = stored(step)
    label = colour.select("node", F.col("label.node").alias("label"))
    within = stored(edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("_s")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("_d")), "dst").where("_s = _d").select("src", "dst"))
    found = stored(label.where("node = label"))
    size, before = found.count(), 0
    while size > before:
        step = found
        for _ in range(HOPS):
            step = step.unionByName(step.join(within, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "label")).distinct()
        found = stored(step)
        size, before = found.count(), size
    return found


def _passed(pointers: DataFrame, marked: DataFrame) -> DataFrame:
    """Nodes on the ways from ``marked (node)`` on, along ``pointers (node, to)`` without rings; ways double in each round."""
    pointers, marked = stored(pointers), stored(marked)
    while True:
        ahead = marked.join(pointers, "node").select(F.col("to").alias("node")).distinct().join(marked, "node", "left_anti")
        new = stored(ahead)
        if new.isEmpty():
            return marked
        marked = stored(marked.unionByName(new))
        second = pointers.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        pointers = stored(pointers.join(second, "to").select("node", F.col("_to").alias("to")))


def _local_components(needs: list[list[int]]) -> list[int]:
    """The strongly connected component of each node of a block: numbers in an order in which needs come first."""
    order, low, found, stack, seen, n = [0] * len(needs), [0] * len(needs), [-1] * len(needs), [], 0, 0
    for start in range(len(needs)):
        if order[start]:
            continue
        way = [(start, iter(needs[start]))]
        order[start] = low[start] = seen = seen + 1
        stack.append(start)
        while way:
            v, ahead = way[-1]
            for w in ahead:
                if not order[w]:
                    order[w] = low[w] = seen = seen + 1
                    stack.append(w)
                    way.append((w, iter(needs[w])))
                    break
                if found[w] < 0:
                    low[v] = min(low[v], order[w])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[v])
                if low[v] == order[v]:
                    while found[v] < 0:
                        found[stack.pop()] = n
                    n += 1
    return found


def _block_graph(src: list, dst: list) -> tuple[list[str], list[list[int]]]:
    names = sorted({x for x in (*src, *dst) if x is not None})
    at = {x: k for k, x in enumerate(names)}
    needs: list[list[int]] = [[] for _ in names]
    for a, b in {(a, b) for a, b in zip(src, dst, strict=True) if a is not None and b is not None}:
        needs[at[a]].append(at[b])
    return names, needs


_EDGE = pa.schema([("src", pa.string()), ("dst", pa.string())])
_LABEL = pa.schema([("node", pa.string()), ("label", pa.string())])


def _reduced(block: pa.Table) -> pa.Table:
    """A block's edges with less: the same ways between nodes that other blocks reach (rows without src) and those that need others (without dst).

    A cycle within the block gives a row from its least node to itself.  Nodes that are only passed
    through are left out where this makes no more edges, and all that is on no way through the block.
    The nodes between blocks that are on such a way come back as they were given, without src or dst.
    """
    src, dst = block.column("src").to_pylist(), block.column("dst").to_pylist()
    names, needs = _block_graph(src, dst)
    found = _local_components(needs)
    n = max(found, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(n)]
    for v, c in enumerate(found):
        members[c].append(v)
    entered, left = {b for a, b in zip(src, dst, strict=True) if a is None}, {a for a, b in zip(src, dst, strict=True) if b is None}
    ways = [[v for v in m if names[v] in entered or names[v] in left] for m in members]
    reached, leads = [any(names[v] in entered for v in m) for m in members], [any(names[v] in left for v in m) for m in members]
    ahead: list[set[int]] = [set() for _ in range(n)]
    behind: list[set[int]] = [set() for _ in range(n)]
    for v, to in enumerate(needs):
        for w in to:
            if found[v] != found[w]:
                ahead[found[v]].add(found[w])
                behind[found[w]].add(found[v])
    for c in range(n):
        leads[c] = leads[c] or any(leads[b] for b in ahead[c])
    for c in reversed(range(n)):
        reached[c] = reached[c] or any(reached[a] for a in behind[c])
    through = {c for c in range(n) if reached[c] and leads[c]}
    for c in range(n):
        ahead[c], behind[c], ways[c] = (ahead[c] & through, behind[c] & through, ways[c]) if c in through else (set(), set(), [])
    todo = deque(through)
    while todo:
        c = todo.popleft()
        if ways[c] or not (ahead[c] or behind[c]) or len(ahead[c]) * len(behind[c]) > len(ahead[c]) + len(behind[c]):
            continue
        for a in behind[c]:
            ahead[a].discard(c)
            ahead[a] |= ahead[c]
        for b in ahead[c]:
            behind[b].discard(c)
            behind[b] |= behind[c]
        todo.extend(x for x in (*behind[c], *ahead[c]) if not ways[x])
        ahead[c], behind[c] = set(), set()
    out = [(names[m[0]],) * 2 for m in members if len(m) > 1]
    for c in range(n):
        out += [(names[a], names[b]) for a, b in zip(ways[c], ways[c][1:] + ways[c][:1], strict=True) if a != b]
        first = ways[c][0] if ways[c] else members[c][0]
        out += [(names[first], names[ways[b][0] if ways[b] else members[b][0]]) for b in ahead[c]]
        out += [(None, names[v]) for v in ways[c] if names[v] in entered] + [(names[v], None) for v in ways[c] if names[v] in left]
    return pa.table([[a for a, _ in out], [b for _, b in out]], schema=_EDGE)


def _labelled(block: pa.Table) -> pa.Table:
    """``node, label`` of a block's nodes in cycles; rows with ``label`` are nodes that lie in one component of that name by ways outside too."""
    src, dst, given = (block.column(c).to_pylist() for c in ("src", "dst", "label"))
    known = {a: label for a, label in zip(src, given, strict=True) if label is not None}
    names, needs = _block_graph(src, dst)
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    for k, name in enumerate(names):
        if (label := known.get(name)) is not None:
            if label in last:
                needs[last[label]].append(k)
            last[label] = k
            first.setdefault(label, k)
    for label, k in last.items():
        needs[k].append(first[label])
    found = _local_components(needs)
    size, label_of = [0] * len(names), {}
    for k, c in enumerate(found):
        size[c] += 1
        label_of[c] = known.get(names[k]) or label_of.get(c) or names[k]
    out = [(name, label_of[c]) for name, c in zip(names, found, strict=True) if size[c] > 1 or name in known]
    return pa.table([[a for a, _ in out], [b for _, b in out]], schema=_LABEL)


def _blocked(edges: DataFrame, size: int, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A level: edges within blocks ``(block, src, dst)``, nodes ``(node, home)`` with needs, and the reduced graph of all blocks.

    A block has the nodes of a range of names; what needs nothing is in no block, and edges to it go.
    """
    dealt = stored(edges.repartitionByRange(n, "src").withColumn("block", F.spark_partition_id()))
    homes = dealt.groupBy(F.col("src").alias("node")).agg(F.first("block").alias("home"))
    placed = stored(dealt.join(homes, F.col("dst") == F.col("node")).select("src", "dst", "block", "home"))
    inside, across = placed.where("block = home").select("block", "src", "dst"), placed.where("block <> home")
    nothing = F.lit(None).cast("string")
    leaving = across.select("block", "src", nothing.alias("dst")).distinct()
    entering = across.select(F.col("home").alias("block"), nothing.alias("src"), "dst").distinct()
    reduced = stored(inside.unionByName(leaving).unionByName(entering).groupBy("block").applyInArrow(_reduced, "src string, dst string"))
    across = across.select("src", "dst").join(reduced.where("dst IS NULL").select("src"), "src", "left_semi").join(reduced.where("src IS NULL").select("dst"), "dst", "left_semi")
    return inside, homes, stored(reduced.where("src IS NOT NULL AND dst IS NOT NULL").unionByName(across.select("src", "dst")))


def _levels(edges: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame, bool]], list[DataFrame], DataFrame, int]:
    """Levels of blocks until nothing is left or they no longer help: each with whether it has cycles of its own, these, and the edges that are left."""
    levels, cyclic, rest = [], [], edges
    size, least = rest.count(), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-size // BLOCK), min(least, 1 + size // LEAST_BLOCK))
    while size:
        inside, homes, reduced = _blocked(rest, size, n)
        loops = reduced.where("src = dst").select(F.col("src").alias("node"))
        levels.append((inside, homes, not loops.isEmpty()))
        cyclic.append(loops)
        rest = reduced.where("src <> dst")
        before, size = size, rest.count()
        if n > 1 and size > BLOCK and size > (1 - WORTH) * before:
            break
        n = -(-size // BLOCK)
    return levels, cyclic, rest, size


def _once(edges: DataFrame) -> DataFrame:
    return stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())


def has_cycles(edges: DataFrame) -> DataFrame:
    """A node of some of the cycles, none if there are none: blocks are only reduced, members not looked for."""
    once = _once(edges)
    levels, cyclic, rest, size = _levels(once.where("src <> dst"))
    found = [once.where("src = dst").select(F.col("src").alias("node")), *cyclic]
    return _union([*found, _peeled(rest).select("node")] if size else found)


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node in a cycle; a component is named by its least node. A node that needs itself is in a cycle.

    Blocks of near names are reduced level by level; components of what is left come back down
    through the levels, where each block finds its own again with the ways outside that join its
    nodes.  Where blocks don't help, edges are taken off, folded and coloured (:func:`_peeled`).
    Rows with a null are no edges.
    """
    once = _once(edges)
    levels, _, rest, size = _levels(once.where("src <> dst"))
    known = _peeled(rest) if size else once.select(F.col("src").alias("node"), F.col("src").alias("label")).limit(0)
    any_known = bool(size) and not known.isEmpty()
    for inside, homes, own in reversed(levels):
        if not (own or any_known):
            continue
        met = known.join(homes, "node").select(F.col("home").alias("block"), F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), "label")
        rows = inside.withColumn("label", F.lit(None).cast("string")).unionByName(met)
        known, any_known = stored(rows.groupBy("block").applyInArrow(_labelled, "node string, label string")), True
    loops = once.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("label"))
    known = stored(known.unionByName(loops.join(known, "node", "left_anti")))
    least = known.groupBy("label").agg(F.min("node").alias("component"))
    return known.join(least, "label").select("node", "component")


def _peeled(rest: DataFrame) -> DataFrame:
    """``node, label`` for each node in a cycle of edges without loops, whatever their names.

    Ends and beginnings are taken off, nodes with one need are folded into where it leads, and what
    neither changes is coloured; then folded nodes come back, those that lie on a way from
    their component to itself.
    """
    looped, labels, phases = [], [], []
    size = rest.count()
    while size:
        rest = stored(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, size = size, rest.count()
        if size < (1 - WORTH) * before:
            continue
        one = stored(rest.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to", F.col("src").alias("low")))
        if one.count() < max(1, WORTH * size):
            found = stored(_coloured(rest, len(labels)))
            labels.append(found)
            rest = stored(rest.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"))
            size = rest.count()
            continue
        ends = followed(one, lambda a, b: {"low": F.least(a("low"), b("low"))})
        # A ring is left at its least node: the way from any node leads into the ring, all of which the second way passes.
        ring = ends.where("open").select(F.col("node").alias("to"), F.col("low").alias("_least"))
        gone = stored(ends.where("NOT open").select("node", "to").unionByName(ends.where("open").join(ring, "to").where("node <> _least").select("node", F.col("_least").alias("to"))))
        kept = rest.join(gone, rest["src"] == gone["node"], "left_anti")
        moved = stored(kept.join(gone, kept["dst"] == gone["node"], "left").select("src", F.coalesce("to", "dst").alias("dst")).distinct())
        phases.append((rest, one.select("node", "to"), gone))
        looped.append(moved.where("src = dst").select(F.col("src").alias("node")))
        rest = moved.where("src <> dst")
        size = rest.count()
    loops = stored(_union([rest.select(F.col("src").alias("node")).limit(0), *looped]).distinct())
    known = loops.withColumn("label", F.col("node"))
    if labels:
        coloured = _union(labels)
        real = coloured.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("label")
        known = coloured.join(real, "label", "left_semi").select("node", "label").unionByName(known.join(coloured.join(real, "label", "left_semi"), "node", "left_anti"))
    known = stored(known)
    for edges_then, pointers, gone in reversed(phases):
        inside = stored(gone.join(known.withColumnRenamed("node", "to"), "to").select("node", "label"))
        if inside.isEmpty():
            continue
        entries = edges_then.join(known.select(F.col("node").alias("src"), F.col("label").alias("_from")), "src").join(inside, F.col("dst") == F.col("node")).where("_from = label").select("node").distinct()
        within = pointers.join(inside.select("node"), "node", "left_semi").join(inside.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to")
        # A ring's node that was folded later belongs to what it was folded into.
        back = stored(_passed(within, entries).join(inside, "node").select("node", "label"))
        known = stored(known.join(back, "node", "left_anti").unionByName(back))
    return known


def cycles(edges: DataFrame) -> DataFrame:
    """One cycle of each component: ``component, place, node``, from place 0 at its least node on.

    From a component's least node on, the way always goes to the least need within the
    component; the cycle that this way ends in is the one.
    """
    member = stored(strong_components(edges))
    inside = edges.select("src", "dst").join(member.select(F.col("node").alias("src"), "component"), "src").join(member.select(F.col("node").alias("dst"), F.col("component").alias("_other")), "dst").where("component = _other")
    step = stored(inside.groupBy(F.col("src").alias("node"), "component").agg(F.min("dst").alias("to")))
    # Ways stay within their component.
    longest = member.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    far = followed(step.select("node", "to", F.col("node").alias("low")), lambda a, b: {"low": F.least(a("low"), b("low"))}, longest)
    first = far.join(member.where("node = component"), "node").select(F.col("to").alias("node"), "component")
    chosen = far.join(first, "node").select("component", F.col("low").alias("start"))
    # All rings of all ways; those of the chosen starts are kept. Steps back to the start give the places.
    ringed = far.select(F.col("to").alias("node")).distinct().join(far.select("node", F.col("low").alias("start")), "node").join(chosen, "start", "left_semi")
    ringed = stored(ringed.join(step, "node").select("node", "start", "component", "to"))
    back = followed(ringed.where("node <> start").select("node", "to", F.lit(1).cast("long").alias("hops")), lambda a, b: {"hops": a("hops") + b("hops")})
    size = ringed.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    placed = ringed.join(back.select("node", "hops"), "node", "left").join(size, "component")
    return placed.select("component", F.coalesce(F.col("_n") - F.col("hops"), F.lit(0)).cast("long").alias("place"), "node")
