"""Pairwise matches consolidated into groups.

``consolidate(pairs, scope, a, b)`` gives every name of a pair its group: the smallest name, in code point order, of all
that are linked to it directly or through others of the same scope.

Method: union-find runs within the partitions the pairs come in, and only spanning forests leave them (a link per name at
most). Forests of scopes that fit a bounded partition are merged there, whole scopes together. A larger scope's forests
are merged in fewer and fewer partitions of about ``bound`` links until one is left. The links of a partition are picked
by a hash of both ends, so a name that all are linked to is spread over all partitions. Where merging stops to shrink the
forests (a tree of more names than a partition holds can't shrink), a round of contraction follows: each name joins its
neighbour of the least hash, about half of the names go, by grouping and joins that no single name can overload. No
component is ever collected beyond the bound.

Defined cases: pairs with a null end are no links, nor do they make the other end a name; a pair of a name with itself
makes a group of one; repeated and reversed pairs change nothing; a null scope is a scope; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.operators.wide import contracted, relabelled
from verdigraph.runtime import by_size, checkpointed, slices, with_scope

#: Links that one task may hold.
BOUND = 1_000_000


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest it is linked to: roots hooked onto smaller ones, paths halved, until none is left."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def forest(part: pa.Table, keys: list[str]) -> pa.Table:
    """Links (a, b) to one link per name: its smallest (a: name, b: smallest; also of the smallest itself)."""
    scope = np.zeros(part.num_rows, np.int64)
    for k in keys:
        codes = part[k].combine_chunks().dictionary_encode(null_encoding="encode")
        scope = scope * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
    _, scope_row, scope = np.unique(scope, return_index=True, return_inverse=True)
    both = pa.chunked_array([*part["a"].chunks, *part["b"].chunks]).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = both.dictionary.take(pa.array(order))
    keyed, ids = np.unique(np.r_[scope, scope] * max(1, len(words)) + rank[both.indices.to_numpy()], return_inverse=True)
    root = roots(len(keyed), ids[: part.num_rows], ids[part.num_rows :])
    node_scope, node = np.divmod(keyed, max(1, len(words)))
    at = pa.array(scope_row[node_scope])
    return pa.table({**{k: part[k].combine_chunks().take(at) for k in keys}, "a": words.take(pa.array(node)), "b": words.take(pa.array(node[root]))})


def consolidate(pairs: DataFrame, scope: list[str], a: str, b: str, bound: int = BOUND, piece: int = 200_000) -> DataFrame:
    """Rows of scope, name, group: one per name. ``piece``: rows that a task takes in at a time."""
    keys = [f"s{i}" for i in range(len(scope))]
    links = pairs.select(*[F.col(c).alias(k) for c, k in zip(scope, keys)], F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    schema = T.StructType([*links.schema.fields[: len(keys)], T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, min(bound, piece)):
            part = part if held is None else pa.concat_tables([held, part.cast(held.schema)]).combine_chunks()
            held = forest(part, keys)
            if held.num_rows >= bound:  # as much as a task may hold: let it go, begin anew
                yield from held.to_batches(max_chunksize=50_000)
                held = None
        if held is not None:
            yield from held.to_batches(max_chunksize=50_000)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, min(bound, piece), keys):
            yield from forest(part, keys).to_batches(max_chunksize=50_000)

    first = checkpointed(links.mapInArrow(local, schema))
    near, wide, large = by_size(first, keys, bound)
    done = (near.repartition(*keys).sortWithinPartitions(*keys) if keys else near.coalesce(1)).mapInArrow(whole, schema)
    if wide is not None:
        found = _merged(checkpointed(wide.select("large", "a", "b")), ["large"], bound, min(bound, piece))
        done = done.unionByName(with_scope(found, large, keys).select(*schema.names))
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, scope)], F.col("a").alias("name"), F.col("b").alias("group"))


def _merged(links: DataFrame, keys: list[str], bound: int, piece: int) -> DataFrame:
    """Groups of scopes too large for a task; keys are never null."""
    names = links.select(*keys, "a").unionByName(links.select(*keys, F.col("b").alias("a"))).distinct()
    links = checkpointed(links.filter("a <> b").distinct())
    schema = links.schema

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches, piece):
            held = forest(part if held is None else pa.concat_tables([held, part.cast(held.schema)]).combine_chunks(), keys)
            held = held.filter(pc.not_equal(held["a"], held["b"])).combine_chunks()
        if held is not None:
            yield from held.to_batches(max_chunksize=50_000)

    steps: list[DataFrame] = []
    size = links.count()
    while size > bound:
        parts = -(-size // bound)
        merged = checkpointed(links.repartition(parts, *keys, "a", "b").mapInArrow(merge, schema).distinct())
        left = merged.count()
        if left > 0.7 * size:
            merged, step = contracted(merged, keys, len(steps))
            steps.append(step)
            left = merged.count()
        links, size = merged, left
    # At most bound links are left. A name without a link to a smaller one has no row here and stays where it is.
    end = links.coalesce(1).mapInArrow(merge, schema).select(*keys, "a", F.col("b").alias("to"))
    return relabelled(names, [*steps, end], keys)
