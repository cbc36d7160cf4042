"""Hierarchies against a brute-force version, in one task and by joins."""

import functools
import random
from collections import defaultdict

import pytest

from verdigraph.operators.hierarchy import COLUMNS, hierarchy

SCHEMA = "g long, child string, parent string, node string"


def brute(links):
    down, up, nodes = defaultdict(set), defaultdict(set), set()
    for c, p in links:
        down[p].add(c)
        up[c].add(p)
        nodes |= {c, p}

    def reach(x):
        seen, todo = set(), list(down[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += down[y]
        return seen

    below = {x: reach(x) for x in nodes}
    cycle = {x: min(y for y in nodes if y == x or (y in below[x] and x in below[y])) for x in nodes if x in below[x]}
    step = {x: cycle.get(x, x) for x in nodes}
    parents = defaultdict(set)
    for c, p in links:
        if step[c] != step[p]:
            parents[step[c]].add(step[p])

    @functools.cache
    def ways(s):
        return [(s,)] if not parents[s] else [w + (s,) for p in parents[s] for w in ways(p)]

    return nodes, cycle, {x: {y for y in below[x] if step[y] != step[x]} for x in nodes}, {x: ways(step[x]) for x in nodes}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for g in range(25):
        n = rng.randint(1, 9)
        links = [(f"é{rng.randrange(n)}", f"é{rng.randrange(n)}") for _ in range(rng.randint(1, 12))]
        out += [(g, *x, "other") for x in (links if g % 2 else [x for x in links if x[0] < x[1]] or [("a", "b")])]
    return [*out, out[0], (99, None, "x", None), (99, "y", None, None), (None, "a", "b", None), (100, "", "x" * 5000, None)]


def test_against_brute_force(spark, rows):
    truth = {}
    for g in {r[0] for r in rows}:
        links = [(r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None]
        if links:
            truth[g] = brute(links)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {e: hierarchy(df, ["g"], "child", "parent", e).collect() for e in COLUMNS}
    assert {(r.g, r.node, r.cycle) for r in got["cycles"]} == {(g, *x) for g, t in truth.items() for x in t[1].items()}
    assert len(got["nodes"]) == sum(len(t[0]) for t in truth.values())
    for r in got["nodes"]:
        ways = truth[r.g][3][r.node]
        assert r.depth == max(map(len, ways)) - 1 == len(r.path) - 1
        assert tuple(r.path) in ways and sorted(r.roots) == sorted({w[0] for w in ways})
        assert r.n_descendants == len(truth[r.g][2][r.node]) and r.cycle == truth[r.g][1].get(r.node)
        assert r.path[r.depth - r.chain_pos] == r.chain
    found = [(r.g, r.node, r.descendant) for r in got["descendants"]]
    assert len(found) == len(set(found)) and set(found) == {(g, x, y) for g, t in truth.items() for x, ys in t[2].items() for y in ys}
    paths = sorted((str(r.g), r.node, tuple(r.path)) for r in got["paths"])
    assert paths == sorted((str(g), x, w) for g, t in truth.items() for x, ws in t[3].items() for w in ws)
    assert len({(r.g, r.node, r.path_no) for r in got["paths"]}) == len(paths)
    cycles = {g: set(t[1].values()) for g, t in truth.items()}
    assert all(list(r.cycle_steps) == [i for i, x in enumerate(r.path) if x in cycles[r.g]] and r.root == r.path[0] for r in got["paths"])


@pytest.mark.parametrize("emit", list(COLUMNS))
def test_same_rows_in_both_ways(spark, rows, emit):
    rng = random.Random(8)
    crossed = [(1000, c, p, None) for c, p in (("x", "a"), ("a", "z"), ("x", "b"), ("b", "c"))]
    layered = [(1001, f"n{i:02d}", f"n{rng.randrange(max(0, i - 9), i // 2 + 1):02d}", None) for i in range(1, 10) for _ in range(1 + (i % 3 == 0))]
    ring = [(1002, f"r{i}", f"r{(i + 1) % 6}", None) for i in range(6)] + [(1002, "r2", "top", None), (1002, "low", "r4", None), (1002, "r9", "low", None)]
    df = spark.createDataFrame([*crossed, *layered, *ring, *(r for r in rows if r[0] is None or r[0] < 3)], SCHEMA)
    plain = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
    near, far, split = (sorted((plain(r) for r in hierarchy(df, ["g"], "child", "parent", emit, bound).collect()), key=repr) for bound in (10**6, 0, 9 if emit == "cycles" else 10**6))
    assert near == far == split
    if emit == "paths":
        number = {r[:2] + (r[4],): r[2] for r in near}
        assert number[1000, "x", ("z", "a", "x")] == 0 and number[1000, "x", ("c", "b", "x")] == 1
    if emit == "nodes":
        cycles = hierarchy(df, ["g"], "child", "parent", emit, only_cycles=True).collect()
        assert sorted(map(plain, cycles), key=repr) == [r for r in near if r[2] is not None]


def test_many_ways(spark):
    n = 15  # diamonds end to end: 2 ** 15 ways
    rows = [(1, f"{i:02d}{side}", f"{i:02d}") for i in range(n) for side in "ab"] + [(1, f"{i + 1:02d}", f"{i:02d}{side}") for i in range(n) for side in "ab"]
    df = spark.createDataFrame(rows, "g long, child string, parent string")
    last = [r for r in hierarchy(df, ["g"], "child", "parent", "paths").collect() if r.node == f"{n:02d}"]
    assert len(last) == len({tuple(r.path) for r in last}) == 2**n and {r.path_no for r in last} == set(range(2**n))
    assert [r.path[::-1] for r in sorted(last, key=lambda r: r.path_no)] == sorted(r.path[::-1] for r in last)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    for emit in COLUMNS:
        assert hierarchy(df, ["g"], "child", "parent", emit).collect() == []


def test_deep_chain(spark):
    n = 3000
    df = spark.createDataFrame([(1, f"{i + 1:05d}", f"{i:05d}") for i in range(n)], "g long, child string, parent string")
    rows = hierarchy(df, ["g"], "child", "parent").collect()
    assert len(rows) == n + 1 and max(r.depth for r in rows) == n
    assert {r.chain for r in rows} == {"00000"} and sum(r.n_descendants for r in rows) == n * (n + 1) // 2
