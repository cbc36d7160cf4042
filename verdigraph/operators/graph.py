"""Graph operators: cycle breaking, components, communities.

Groups are brought together by scope and worked on in slices of whole scopes, as arrays. Cycle breaking and communities
are by definition one walk through a graph, so a single scope is the unit they are spread by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.operators.hierarchy import Links, distinct
from verdigraph.operators.wide import contracted, relabelled
from verdigraph.runtime import by_size, checkpointed, slices, with_scope

#: Links of a scope that components are found for in one task.
BOUND = 2_000_000


def coded(part: pa.Table, keys: list[str], *ends: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, list[np.ndarray]]:
    """Nodes as numbers, in order of scope and name: their names' places, a row of each one's scope, names, scope, ends."""
    scope = np.zeros(part.num_rows, np.int64)
    for k in keys:
        codes = part[k].combine_chunks().dictionary_encode(null_encoding="encode")
        scope = scope * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    _, first, scope = np.unique(scope, return_index=True, return_inverse=True)
    both = pa.chunked_array([c for e in ends for c in part[e].chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = max(1, len(order))
    keyed, ids = np.unique(np.tile(scope, len(ends)) * n + rank[both.indices.to_numpy()], return_inverse=True)
    of, name = np.divmod(keyed, n)
    return name, first[of], both.dictionary.take(pa.array(order)), of, np.split(ids, len(ends))


def _grouped(links: DataFrame, scope: list[str], fields: str, work) -> DataFrame:  # noqa: ANN001
    schema = T.StructType([*(links.schema[k] for k in scope), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 200_000, scope):
            name, row, words, of, ends = coded(part, scope, "source", "target")
            at, columns = work(len(name), of, *ends)
            made = {k: part[k].combine_chunks().take(pa.array(row[at])) for k in scope}
            made |= {c: words.take(pa.array(name[x])) for c, x in zip(names[len(scope) :], columns)}
            yield from pa.table(made).to_batches(max_chunksize=50_000)

    near = links.repartition(*scope).sortWithinPartitions(*scope) if scope else links.coalesce(1)
    return near.mapInArrow(run, schema)


def back_edges(links: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, source, target) of links to remove so that no cycle is left.

    They are those that one walk in depth finds leading back into its own way: sources in order, each one's targets in
    order, nodes in the order these name them.
    """
    return _grouped(links.select(*scope, "source", "target"), scope, "source string, target string", _back)


def _back(n: int, of: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    u, v = distinct(u, v)
    order = np.column_stack((u, v)).ravel()
    _, first = np.unique(order, return_index=True)
    starts = order[np.sort(first)].tolist()
    out = Links.of(n, u, v)
    at, to = out.at.tolist(), out.to.tolist()
    state = bytearray(n)  # 1: on the way, 2: done
    nxt = at[:-1]
    removed: list[tuple[int, int]] = []
    for s in starts:
        if state[s]:
            continue
        way = [s]
        state[s] = 1
        while way:
            x = way[-1]
            if nxt[x] < at[x + 1]:
                y = to[nxt[x]]
                nxt[x] += 1
                if state[y] == 1:
                    removed.append((x, y))
                elif not state[y]:
                    state[y] = 1
                    way.append(y)
            else:
                state[x] = 2
                way.pop()
    a, b = (np.array([r[i] for r in removed], np.int64) for i in (0, 1))
    return a, (a, b)


def break_cycles(typed: DataFrame, kinds: DataFrame, on: list[str], scope: list[str]) -> DataFrame:
    """Typed relations without those that close a cycle in a kind that is directed and acyclic."""
    strict = typed.join(kinds.filter("directed and acyclic").select(*on), on, "left_semi")
    keys = [*dict.fromkeys([*scope, "relation"])]
    removed = back_edges(strict, keys)
    return typed.join(removed, [*keys, "source", "target"], "left_anti")


def components(links: DataFrame, names: DataFrame, scope: list[str], bound: int = BOUND) -> DataFrame:
    """(scope, name, component): component is its smallest name; names without links are their own."""
    links = links.select(*scope, "source", "target").unionByName(names.select(*scope, F.col("name").alias("source"), F.col("name").alias("target")))
    links, wide, large = by_size(links, scope, bound)
    near = _grouped(links, scope, "name string, component string", lambda n, of, u, v: (np.arange(n), (np.arange(n), _roots(n, u, v))))
    if wide is None:
        return near
    pairs = checkpointed(wide.select("large", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct())
    ends = pairs.select("large", "a").unionByName(pairs.select("large", F.col("b").alias("a"))).distinct()
    left, steps = pairs.filter("a <> b"), []
    while left.count() > bound:
        left, step = contracted(left, ["large"], len(steps))
        steps.append(step)
    last = _grouped(left.select("large", F.col("a").alias("source"), F.col("b").alias("target")), ["large"], "a string, to string", lambda n, of, u, v: (np.arange(n), (np.arange(n), _roots(n, u, v))))
    found = relabelled(ends, [*steps, last], ["large"]).select("large", F.col("a").alias("name"), F.col("b").alias("component"))
    return near.unionByName(with_scope(found, large, scope).select(*near.columns))


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        if np.array_equal(a, b):
            return least
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(least, least[least]):
            least = least[least]


def communities(links: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, community): communities of high modularity (Blondel et al., 2008) of the undirected simple graph.

    Deterministic: nodes are visited in order of their names. A community is named by its smallest name.
    """
    own = names.select(*scope, F.col("name").alias("source"), F.col("name").alias("target"))
    return _grouped(links.select(*scope, "source", "target").unionByName(own), scope, "name string, community string", _louvain)


def _louvain(n: int, of: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    a, b = distinct(np.minimum(u, v), np.maximum(u, v))
    a, b = a[a != b], b[a != b]
    total = np.bincount(of[a], minlength=int(of.max(initial=0)) + 1).astype(float)  # links of each scope
    member, scope = np.arange(n), of
    weight, loops = np.ones(len(a)), np.zeros(n)
    while len(a):
        size = len(scope)
        both = Links.of(size, np.r_[a, b], np.arange(2 * len(a)))
        to, w = np.r_[b, a][both.to].tolist(), np.r_[weight, weight][both.to].tolist()
        at = both.at.tolist()
        degree = (np.bincount(a, weight, size) + np.bincount(b, weight, size) + 2 * loops).tolist()
        twice = (2 * total[scope]).tolist()
        where, load = list(range(size)), list(degree)
        moved = changed = True
        while changed:
            changed = False
            for x in range(size):
                if at[x] == at[x + 1]:
                    continue
                here = where[x]
                near: dict[int, float] = {here: 0.0}
                for k in range(at[x], at[x + 1]):
                    if to[k] != x:
                        near[where[to[k]]] = near.get(where[to[k]], 0.0) + w[k]
                load[here] -= degree[x]
                best, gain = here, near[here] - load[here] * degree[x] / twice[x]
                for c in sorted(near):
                    g = near[c] - load[c] * degree[x] / twice[x]
                    if g > gain + 1e-12:
                        best, gain = c, g
                load[best] += degree[x]
                if best != here:
                    where[x], changed = best, True
        new, index = np.unique(np.array(where), return_inverse=True)
        if len(new) == size:
            moved = False
        member = index[member]
        if not moved:
            break
        scope = scope[new]
        kept = np.bincount(index, loops, len(new))
        ca, cb = index[a], index[b]
        inner = ca == cb
        loops = kept + np.bincount(ca[inner], weight[inner], len(new))
        lo, hi = np.minimum(ca, cb)[~inner], np.maximum(ca, cb)[~inner]
        pair, place = np.unique(lo * len(new) + hi, return_inverse=True)
        weight = np.bincount(place, weight[~inner], len(pair))
        a, b = np.divmod(pair, len(new))
    least = np.full(int(member.max(initial=0)) + 1, n)
    np.minimum.at(least, member, np.arange(n))
    return np.arange(n), (np.arange(n), least[member])


def hubs(groups: DataFrame, links: DataFrame, scope: list[str], group: str) -> DataFrame:
    """(scope, group, label): each group is labelled by its best linked member (ties: shorter, then later in order)."""
    a, b = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    simple = links.select(*scope, a, b).distinct()
    degree = simple.select(*scope, F.explode(F.array("a", "b")).alias("name")).groupBy(*scope, "name").count()
    known = groups.join(degree, [*scope, "name"], "left").withColumn("degree", F.coalesce("count", F.lit(0)))
    best = F.max(F.struct("degree", -F.char_length("name"), "name")).alias("m")
    return known.groupBy(*scope, group).agg(best).select(*scope, group, F.concat(F.lit("Cluster · "), F.col("m.name")).alias("label"))
