"""Parent-child links to full hierarchies.

``hierarchy(edges, scope, child, parent)`` takes links in long form. Every scope (a graph, say) is a hierarchy of its
own. Per scope:

1. *Cycle separation.* Nodes that can't lie on a cycle are peeled off from both ends; what stays is split into strongly
   connected components. A component of two or more nodes, or a node linked to itself, is a cycle, named by its smallest
   member in code point order. From here on a cycle is one step of the hierarchy: it is named, never followed.
2. *Heavy paths.* Each step's deepest parent (ties: smallest name) makes a spanning forest; subtree sizes pick each
   step's heavy child; heavy edges form chains, each node labelled with its chain and its place there.
3. *Paths* are chain segments, concatenated: up to the next step with several parents, or the chain's first, a way has
   no choice. Ways are counted top down, so the k-th of a step is made from its number alone and none is kept.
   *Descendants* are chain intervals: what is reached on a chain is always the rest of it from one place on, so the
   intervals of the children are merged bottom up.

Everything is done on arrays for a whole slice of scopes at once. Links are shuffled once, by scope. A scope with more
than ``bound`` links isn't given to one task: chains, intervals and segments are then found by joins (see ``wide.py``),
with the same rows. The ways of a step are numbered by their names, compared from the step upwards.

Defined cases: links with a null end are no links (their other end is no node by them); repeated links count once; a
null scope value is a scope like any other; blank and very long names are names; an empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.runtime import by_size, slices, with_scope

#: Links of a scope that one task may hold.
BOUND = 2_000_000
#: Links worked on at once in a task.
SLICE = 400_000
#: Rows of an output batch.
ROWS = 50_000
#: Steps of all paths of an output batch, about.
PASSED = 2_000_000

COLUMNS = {
    "cycles": "node string, cycle string",
    "nodes": "node string, cycle string, depth int, roots array<string>, path array<string>, chain string, chain_pos int, n_descendants long",
    "paths": "node string, path_no long, root string, path array<string>, cycle_steps array<int>",
    "descendants": "node string, descendant string",
}


def hierarchy(edges: DataFrame, scope: list[str], child: str, parent: str, emit: str = "nodes", bound: int = BOUND, only_cycles: bool = False) -> DataFrame:
    """Rows of ``scope`` and the columns of ``COLUMNS[emit]``.

    cycles: one row per node on a cycle. nodes: one row per node, with the path along its deepest parents (with
    ``only_cycles``, per node on a cycle). paths: one row per node and way down from a root; ``cycle_steps`` has the places
    of the path, from 0, that are cycles. descendants: one row per node and node below it; members of a node's own cycle
    aren't below it.
    """
    keys = [f"s{i}" for i in range(len(scope))]
    links = edges.select(*[F.col(c).alias(k) for k, c in zip(keys, scope)], F.col(child).alias("child"), F.col(parent).alias("parent")).filter("child is not null and parent is not null")
    fields = T.StructType([T.StructField(k, links.schema[k].dataType) for k in keys] + list(T._parse_datatype_string(COLUMNS[emit]).fields))
    names = [f.name for f in fields]
    links, wide, large = by_size(links, keys, bound)
    found = None
    if wide is not None:
        from verdigraph.operators.wide import wide_hierarchy

        found = with_scope(wide_hierarchy(wide.select("large", "child", "parent"), ["large"], emit, bound), large, keys)
        found = found.filter("cycle is not null") if only_cycles else found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, keys):
            yield from _rows(part, keys, emit, names, only_cycles)

    near = (links.repartition(*keys).sortWithinPartitions(*keys) if keys else links.coalesce(1)).mapInArrow(run, fields)
    out = near if found is None else near.unionByName(found.select(*names))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, scope)], *names[len(keys) :])


# --- arrays -----------------------------------------------------------------------------------------------------------


@dataclass
class Links:
    """Links in both directions: ``to[at[i]:at[i + 1]]`` are those of node i."""

    at: np.ndarray
    to: np.ndarray

    @staticmethod
    def of(n: int, here: np.ndarray, there: np.ndarray) -> Links:
        order = np.lexsort((there, here))
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(here, minlength=n), out=at[1:])
        return Links(at, there[order])

    def of_nodes(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every link of ``nodes``: the place of the node in ``nodes``, and the other end."""
        counts = self.at[nodes + 1] - self.at[nodes]
        who = np.repeat(np.arange(len(nodes)), counts)
        return who, self.to[spans(self.at[nodes], counts)]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def cycle_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each node the smallest node of its cycle, -1 off cycles."""
    out = np.full(n, -1, np.int64)
    loops = u == v
    out[u[loops]] = u[loops]
    u, v = u[~loops], v[~loops]
    down, up = Links.of(n, u, v), Links.of(n, v, u)
    n_out, n_in = np.diff(down.at), np.diff(up.at)
    alive = np.ones(n, bool)
    front = np.flatnonzero((n_out == 0) | (n_in == 0))
    while len(front):
        alive[front] = False
        near = []
        for links, counts in ((down, n_in), (up, n_out)):
            _, ends = links.of_nodes(front)
            ends, times = np.unique(ends, return_counts=True)
            counts[ends] -= times
            near.append(ends[(counts[ends] == 0) & alive[ends]])
        front = np.unique(np.concatenate(near))
    core = np.flatnonzero(alive)
    if not len(core):
        return out
    new = np.full(n, -1, np.int64)
    new[core] = np.arange(len(core))
    keep = alive[u] & alive[v]
    small = Links.of(len(core), new[u[keep]], new[v[keep]])
    component = _components(len(core), small)
    least = np.full(len(core), len(core), np.int64)
    np.minimum.at(least, component, np.arange(len(core)))
    real = np.bincount(component, minlength=len(core))[component] > 1
    out[core[real]] = core[least[component[real]]]
    return out


def _components(n: int, links: Links) -> np.ndarray:
    """Strongly connected components, by one walk in depth (Tarjan, 1972), with a stack of its own."""
    at, to = links.at.tolist(), links.to.tolist()
    index, low, component = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = made = 0
    for first in range(n):
        if index[first] >= 0:
            continue
        index[first] = low[first] = count
        count += 1
        stack.append(first)
        walk, nxt = [first], [at[first]]
        while walk:
            x = walk[-1]
            if nxt[-1] < at[x + 1]:
                y = to[nxt[-1]]
                nxt[-1] += 1
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    walk.append(y)
                    nxt.append(at[y])
                elif component[y] < 0 and index[y] < low[x]:
                    low[x] = index[y]
                continue
            walk.pop()
            nxt.pop()
            if walk and low[x] < low[walk[-1]]:
                low[walk[-1]] = low[x]
            if low[x] == index[x]:
                while True:
                    y = stack.pop()
                    component[y] = made
                    if y == x:
                        break
                made += 1
    return np.array(component, np.int64)


@dataclass
class Forest:
    """Steps (single nodes, or cycles by their smallest member) in chains."""

    n: int
    up: Links
    down: Links
    step: np.ndarray
    depth: np.ndarray = field(init=False)
    levels: list[np.ndarray] = field(init=False)
    above: np.ndarray = field(init=False)
    chain: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = self.n
        self.depth = np.zeros(n, np.int64)
        waits = np.diff(self.up.at)
        front = np.flatnonzero((waits == 0) & (self.step == np.arange(n)))
        self.levels = []
        while len(front):
            self.depth[front] = len(self.levels)
            self.levels.append(front)
            _, below = self.down.of_nodes(front)
            below, times = np.unique(below, return_counts=True)
            waits[below] -= times
            front = below[waits[below] == 0]
        self.above = np.full(n, -1, np.int64)
        self.chain, self.place = np.arange(n), np.zeros(n, np.int64)
        for level in self.levels[1:]:  # the deepest parent; of those, links being sorted, the first
            who, parents = self.up.of_nodes(level)
            deep = self.depth[parents] == self.depth[level[who]] - 1
            who, parents = who[deep], parents[deep]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            self.above[level[who[first]]] = parents[first]
        size = np.ones(n, np.int64)
        for level in self.levels[:0:-1]:
            np.add.at(size, self.above[level], size[level])
        heavy = np.full(n, -1, np.int64)
        has = np.flatnonzero(self.above >= 0)
        order = has[np.lexsort((has, -size[has], self.above[has]))]
        first = np.r_[True, self.above[order[1:]] != self.above[order[:-1]]] if len(order) else np.zeros(0, bool)
        heavy[self.above[order[first]]] = order[first]
        for level in self.levels[1:]:
            on = level[heavy[self.above[level]] == level]
            self.chain[on] = self.chain[self.above[on]]
            self.place[on] = self.place[self.above[on]] + 1

    @cached_property
    def chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All steps by chain and place; where each chain begins there, and its length."""
        steps = np.concatenate(self.levels) if self.levels else np.zeros(0, np.int64)
        steps = steps[np.lexsort((self.place[steps], self.chain[steps]))]
        length = np.bincount(self.chain[steps], minlength=self.n)
        return steps, np.cumsum(length) - length, length

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(step, root) for all steps, sorted; a root is its own."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(self.levels[0], self.levels[0])] if self.levels else []
        done = Bag(self.n, *pairs[0]) if pairs else None
        for level in self.levels[1:]:
            who, parents = self.up.of_nodes(level)
            again, root = done.of(parents)
            step, root = distinct(level[who[again]], root)
            done.add(step, root)
        return done.all() if done else (np.zeros(0, np.int64),) * 2

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(step, chain, first place): the step has below it the rest of the chain from there on."""
        bag = Bag(self.n, *(np.zeros(0, np.int64),) * 3)
        height = np.zeros(self.n, np.int64)
        for level in self.levels[::-1]:
            who, below = self.down.of_nodes(level)
            np.maximum.at(height, level[who], height[below] + 1)
        steps = np.concatenate(self.levels) if self.levels else np.zeros(0, np.int64)
        order = steps[np.argsort(height[steps], kind="stable")]
        for level in np.split(order, np.flatnonzero(np.diff(height[order])) + 1):
            who, below = self.down.of_nodes(level)
            if not len(who):
                continue
            again, chain, place = bag.of(below)
            step = np.concatenate((level[who], level[who[again]]))
            chain, place = np.concatenate((self.chain[below], chain)), np.concatenate((self.place[below], place))
            sort = np.lexsort((place, chain, step))
            step, chain, place = step[sort], chain[sort], place[sort]
            first = np.r_[True, (step[1:] != step[:-1]) | (chain[1:] != chain[:-1])]
            bag.add(step[first], chain[first], place[first])
        return bag.all()

    def ways(self) -> np.ndarray:
        """How many ways lead down to each step."""
        n = np.zeros(self.n, np.int64)
        if self.levels:
            n[self.levels[0]] = 1
        for level in self.levels[1:]:
            who, parents = self.up.of_nodes(level)
            if n[parents].sum(dtype=float) > 1 << 62:
                raise OverflowError("more ways than can be numbered")
            np.add.at(n, level[who], n[parents])
        return n

    def entries(self) -> np.ndarray:
        """For each step the nearest one of its chain, itself or above, that has other parents than its chain's, or none."""
        out = np.arange(self.n)
        one = (np.diff(self.up.at) == 1) & (self.place > 0)
        for level in self.levels[1:]:
            on = level[one[level]]
            out[on] = out[self.above[on]]
        return out

    def paths(self, n_ways: np.ndarray, entry: np.ndarray, step: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ways by step and number: their lengths, and all steps passed, end to end, as concatenated chain segments."""
        steps, begins, _ = self.chains
        until = np.concatenate(([0], np.cumsum(n_ways[self.up.to])))  # ways through all parents so far
        segments, length = [], np.zeros(len(step), np.int64)
        row, here, k = np.arange(len(step)), step, number
        while len(row):
            top = entry[here]
            size = self.place[here] - self.place[top] + 1
            segments.append((row, begins[self.chain[here]] + self.place[top], size))
            length[row] += size
            going = self.up.at[top + 1] > self.up.at[top]
            row, top, k = row[going], top[going], k[going]
            nth = until[self.up.at[top]] + k
            link = np.searchsorted(until, nth, "right") - 1
            here, k = self.up.to[link], nth - until[link]
        out = np.empty(int(length.sum()), np.int64)
        end = np.cumsum(length)
        for row, start, size in segments:
            end[row] -= size
            out[spans(end[row], size)] = steps[spans(start, size)]
        return length, out


class Bag:
    """Values by step; the values of a step are added once, together."""

    def __init__(self, n: int, step: np.ndarray, *values: np.ndarray) -> None:
        self.start, self.count, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        self.step: list[np.ndarray] = []
        self.values: list[list[np.ndarray]] = [[] for _ in values]
        self.flat: list[np.ndarray] = [np.zeros(0, np.int64) for _ in values]
        self.add(step, *values)

    def add(self, step: np.ndarray, *values: np.ndarray) -> None:
        if len(step):
            first = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
            self.start[step[first]] = self.size + first
            self.count[step[first]] = np.diff(np.r_[first, len(step)])
            self.size += len(step)
            self.step.append(step)
            for k, x in enumerate(values):
                self._put(k, x)

    def _put(self, k: int, x: np.ndarray) -> None:
        held = self.size - len(x)
        if len(self.flat[k]) < self.size:
            self.flat[k] = np.concatenate((self.flat[k][:held], np.zeros(max(self.size, len(x)), np.int64)))
        self.flat[k][held : self.size] = x

    def of(self, steps: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every value of ``steps``: the place of the step in ``steps``, and the values."""
        counts = self.count[steps]
        take = spans(self.start[steps], counts)
        return np.repeat(np.arange(len(steps)), counts), *(x[take] for x in self.flat)

    def all(self) -> tuple[np.ndarray, ...]:
        step = np.concatenate(self.step) if self.step else np.zeros(0, np.int64)
        order = np.argsort(step, kind="stable")
        return step[order], *(x[: self.size][order] for x in self.flat)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[new], b[new]


# --- from and to Arrow ------------------------------------------------------------------------------------------------


def _rows(part: pa.Table, keys: list[str], emit: str, names: list[str], only_cycles: bool = False) -> Iterator[pa.RecordBatch]:
    m = part.num_rows
    scope_code = np.zeros(m, np.int64)
    for k in keys:
        codes = part[k].combine_chunks().dictionary_encode(null_encoding="encode")
        scope_code = scope_code * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    _, scope_row, scope_code = np.unique(scope_code, return_index=True, return_inverse=True)
    both = pa.chunked_array([*part["child"].chunks, *part["parent"].chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    name = rank[both.indices.to_numpy()]
    words = both.dictionary.take(pa.array(order))
    keyed, ids = np.unique(np.r_[scope_code, scope_code] * len(words) + name, return_inverse=True)
    n = len(keyed)
    node_scope, node_name = np.divmod(keyed, len(words))
    u, v = distinct(ids[:m], ids[m:])  # child, parent

    def out(nodes: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        first = {k: part[k].combine_chunks().take(pa.array(scope_row[node_scope[nodes]])) for k in keys}
        whole = pa.table({**first, "node": words.take(pa.array(node_name[nodes])), **columns}).select(names)
        yield from whole.to_batches(max_chunksize=ROWS)

    text = lambda nodes: words.take(pa.array(node_name[nodes]))
    lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)

    cycle = cycle_of(n, u, v)
    on = np.flatnonzero(cycle >= 0)
    if emit == "cycles":
        yield from out(on, cycle=text(cycle[on]))
        return
    step = np.where(cycle >= 0, cycle, np.arange(n))
    cu, cv = step[u], step[v]
    cu, cv = distinct(cu[cu != cv], cv[cu != cv])
    forest = Forest(n, Links.of(n, cu, cv), Links.of(n, cv, cu), step)
    member_order = np.argsort(step, kind="stable")
    members = np.bincount(step, minlength=n)
    member_at = np.cumsum(members) - members
    if emit == "paths":
        n_ways, entry = forest.ways(), forest.entries()
        until = np.cumsum(n_ways[step])  # rows of all nodes so far
        many = max(1, min(ROWS, PASSED // max(1, len(forest.levels))))
        for a in range(0, int(until[-1]) if n else 0, many):
            nth = np.arange(a, min(a + many, int(until[-1])))
            nodes = np.searchsorted(until, nth, "right")
            s = step[nodes]
            number = nth - (until[nodes] - n_ways[s])
            length, passed = forest.paths(n_ways, entry, s, number)
            starts = np.cumsum(length) - length
            is_cycle = cycle[passed] >= 0
            owner = np.repeat(np.arange(len(s)), length)
            places = (np.arange(len(passed)) - starts[owner])[is_cycle].astype(np.int32)
            yield from out(
                nodes,
                path_no=pa.array(number),
                root=text(passed[starts]),
                path=lists(length, text(passed)),
                cycle_steps=lists(np.bincount(owner[is_cycle], minlength=len(s)), pa.array(places)),
            )
        return
    at, chain, place = forest.intervals()
    steps, begins, lengths = forest.chains
    rest = lengths[chain] - place
    if emit == "descendants":
        for a in range(0, len(at), ROWS):
            who = np.repeat(at[a : a + ROWS], rest[a : a + ROWS])
            below = steps[spans(begins[chain[a : a + ROWS]] + place[a : a + ROWS], rest[a : a + ROWS])]
            who, below = np.repeat(who, members[below]), member_order[spans(member_at[below], members[below])]
            below = np.repeat(below, members[who])
            who = member_order[spans(member_at[who], members[who])]
            yield from out(who, descendant=text(below))
        return
    n_below = np.zeros(n, np.int64)
    weight = np.concatenate((np.cumsum(members[steps][::-1])[::-1], [0]))  # members from a place on, over all chains
    ends = begins[chain] + lengths[chain]
    np.add.at(n_below, at, weight[begins[chain] + place] - weight[ends])
    r_step, r_root = forest.roots()
    r_count = np.bincount(r_step, minlength=n)
    r_at = np.cumsum(r_count) - r_count
    wanted = on if only_cycles else np.arange(n)
    many = max(1, min(ROWS, PASSED // max(1, len(forest.levels))))
    for a in range(0, len(wanted), many):
        nodes = wanted[a : a + many]
        s = step[nodes]
        roots = r_root[spans(r_at[s], r_count[s])]
        count, passed = _upward(forest, begins, steps, s)
        yield from out(
            nodes,
            cycle=words.take(pa.array(np.where(cycle[nodes] >= 0, node_name[cycle[nodes]], -1), mask=cycle[nodes] < 0)),
            depth=pa.array(forest.depth[s].astype(np.int32)),
            roots=lists(r_count[s], text(roots)),
            path=lists(count, text(passed)),
            chain=text(forest.chain[s]),
            chain_pos=pa.array(forest.place[s].astype(np.int32)),
            n_descendants=pa.array(n_below[s]),
        )


def _upward(forest: Forest, begins: np.ndarray, steps: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The path of each step along its parents in the forest, a chain segment at a time: lengths, and steps end to end."""
    length = forest.depth[s] + 1
    out = np.empty(int(length.sum()), np.int64)
    end = np.cumsum(length)
    which, here = np.arange(len(s)), s
    end = end.copy()
    while len(which):
        part = forest.place[here] + 1
        out[spans(end[which] - part, part)] = steps[spans(begins[forest.chain[here]], part)]
        end[which] -= part
        above = forest.above[forest.chain[here]]  # a chain is named by its first step
        which, here = which[above >= 0], above[above >= 0]
    return length, out
