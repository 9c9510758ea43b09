"""Components, cycles and depths against brute force, on many small random graphs at once and on long chains."""

import random

import pytest

from tidemark.operators import contraction, graph
from tidemark.operators.contraction import cycles, longest_paths, strong_components


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def random_edges():
    rnd = random.Random(5)
    out = []
    for g in range(60):
        n = rnd.randrange(2, 12)
        out += [(f"g{g:02}.{rnd.randrange(n):02}", f"g{g:02}.{rnd.randrange(n):02}") for _ in range(rnd.randrange(1, 2 * n))]
    return out


def reach(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    found = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), list(to.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        found[start] = seen
    return found


@pytest.fixture(scope="module")
def tangle(spark):
    edges = random_edges()
    return edges, frame(spark, [*edges, *edges[:20], ("only", None), (None, "only")]), reach(edges)


def test_components_and_cycles(tangle):
    edges, df, ahead = tangle
    expected = {v: min(u for u in ahead[v] if v in ahead[u]) for v in ahead if v in ahead[v]}
    assert {(r.node, r.component) for r in strong_components(df).collect()} == set(expected.items())
    rings = {}
    for start in {c for c in expected.values()}:
        path = [start]
        while path.count(path[-1]) < 2:
            path.append(min(b for a, b in edges if a == path[-1] and expected.get(b) == start))
        ring = path[path.index(path[-1]) : -1]
        k = ring.index(min(ring))
        rings[start] = [*ring[k:], *ring[:k], ring[k]]
    assert {r.component: r.path for r in graph.cycle_paths(df).collect()} == rings


def test_depths(tangle):
    edges, df, ahead = tangle
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
    bad = {v for v in ahead if any(u in ahead[u] for u in [v, *ahead[v]])}

    def depth(v):
        return max((depth(u) + 1 for u in needs.get(v, ())), default=0)

    assert {r.node: r.depth for r in longest_paths(df).collect()} == {v: depth(v) for v in ahead if v not in bad}


def test_long_chain(spark):
    """Ten thousand nodes in a row: rounds grow with the logarithm of their number."""
    chain = [(f"n{i:05}", f"n{i + 1:05}") for i in range(10_000)]
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.node: r.depth for r in longest_paths(frame(spark, chain)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    assert got == {f"n{i:05}": 10_000 - i for i in range(10_001)} and jobs < 80
    assert strong_components(frame(spark, chain)).isEmpty()


def test_strict_order(spark):
    with pytest.raises(graph.CircularDependency, match="a -> b -> a"):
        graph.depths(frame(spark, [("a", "b"), ("b", "a"), ("c", "a")]), strict=True)
    assert graph.depths(frame(spark, [("a", "b"), ("b", "c")]), strict=True).count() == 3
    empty = spark.createDataFrame([], "src string, dst string")
    assert strong_components(empty).isEmpty() and longest_paths(empty).isEmpty() and cycles(empty).isEmpty()


def test_object_edges(spark):
    """A name is looked for in its own schema, then in the default one; a view before a table of the same schema."""
    objects = [("table", None, "T", None), ("table", "s", "t", None), ("table", None, "u", None), ("view", "s", "v", "select 1 from T join u on 1=1 join X.y z"), ("view", None, "u", None), ("procedure", "s", "p", "begin select * from V; end"), ("index", "s", "i", None), (None, "s", "n", "from t"), ("trigger", "s", "g", None)]
    stated = [("index", "s", "i", "on", None, "T"), ("table", "s", "t", "foreign_key", None, "u"), ("table", "s", "t", "inherits", "PUBLIC", "t"), ("trigger", "s", "g", "calls", None, "p"), ("trigger", "s", "g", "follows", None, "gone"), ("trigger", "s", "g", "on", None, None)]
    got = graph.object_edges(spark.createDataFrame(objects, "kind string, schema_name string, name string, sql_text string"), spark.createDataFrame(stated, "kind string, schema_name string, name string, via string, ref_schema string, ref_name string"))
    assert {tuple(r) for r in got.collect()} == {
        ("s.index.i", "s.table.t", "on", True),
        ("s.table.t", "public.table.u", "foreign_key", True),
        ("s.table.t", "public.table.t", "inherits", True),
        ("s.trigger.g", "s.procedure.p", "calls", True),
        ("s.trigger.g", "s.trigger.gone", "follows", False),
        ("s.view.v", "s.table.t", "view_text", True),
        ("s.view.v", "public.view.u", "view_text", True),
        ("s.view.v", "x.table.y", "view_text", False),
        ("s.procedure.p", "s.table.v", "procedure_text", False),
    }


def test_blocks(spark, tangle, monkeypatch):
    """Blocks of a few edges, level by level, and graphs that blocks don't help give the same components; a row of rings takes few jobs."""
    edges, df, ahead = tangle
    expected = {v: min(u for u in ahead[v] if v in ahead[u]) for v in ahead if v in ahead[v]}
    for least, most in ((5, 40),):
        monkeypatch.setattr(contraction, "LEAST_BLOCK", least)
        monkeypatch.setattr(contraction, "BLOCK", most)
        assert {(r.node, r.component) for r in strong_components(df).collect()} == set(expected.items())
    monkeypatch.undo()
    rings = [(f"n{i:04}", f"n{i // 7 * 7 + (i + 1) % 7:04}") for i in range(7 * 300)] + [(f"n{i:04}", f"n{i + 7:04}") for i in range(0, 7 * 299, 5)]
    monkeypatch.setattr(contraction, "BLOCK", 600)
    spark.sparkContext.setJobGroup("rings", "rings")
    got = {(r.node, r.component) for r in strong_components(frame(spark, rings)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rings"))
    assert got == {(f"n{i:04}", f"n{i // 7 * 7:04}") for i in range(7 * 300)} and jobs < 100
    assert [r.has_cycle for r in graph.has_cycle(frame(spark, rings)).collect()] == [True]
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(2000)]
    assert [r.has_cycle for r in graph.has_cycle(frame(spark, chain)).collect()] == [False]
    assert [r.has_cycle for r in graph.has_cycle(frame(spark, [*chain, ("n1900", "n0010")])).collect()] == [True]
