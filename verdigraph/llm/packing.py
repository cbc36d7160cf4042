"""Items of varying length packed into containers of fixed capacity.

``pack(sizes, budgets, ...)`` places every item for every budget. An item above the capacity, and only such, is cut into
full containers and a rest that is packed like an item.

Method: items are routed to tiers of context size (down from the capacity by halves); each tier is packed, largest
items first, and the gaps of its containers are filled from the same and the shorter tiers; containers, fullest first,
go to step groups there and back, so that the groups carry about the same load.

Only the number of items of each size is needed for the plan, at most ``capacity`` numbers however many items there are.
The plan is a list of patterns ("so many containers of these sizes"), each using up a size, so its length is bounded by
the capacity too; it is made on the driver and sent to the executors. Every item then finds its place by its size and its
rank among the items of that size. Ranks are counted in parallel: per size in many buckets, with running totals of the
buckets, so a size of which a third of all items are is no task of its own.

Defined cases: items of size 0 take no room and are in no container (null); null sizes count as 0; ties are ordered by
key; repeated keys are items of their own only if their rows can be told apart, so keys must be unique; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items of a size that one bucket, ranked by one task, should have about; and the least number of buckets.
BUCKET = 1_000_000
BUCKETS = 64
#: Containers of a step group.
STEP = 64


def tiers(capacity: int, least: int = 32) -> list[int]:
    """Upper ends of the tiers, longest first."""
    out = [capacity]
    while out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of containers, [(size, how many of it in each)]) that use up ``counts``."""
    left = {s: n for s, n in counts.items() if n > 0}
    ends = tiers(capacity)
    shelves = [sorted(s for s in left if low < s <= high) for high, low in zip(ends, [*ends[1:], 0])]
    out = []
    for k in range(len(shelves)):
        while shelves[k]:
            gap, pattern = capacity, []
            for shelf in shelves[k:]:  # the tier itself, then the shorter ones
                at = len(shelf)
                while gap and at:
                    at = bisect.bisect_right(shelf, gap, 0, at)
                    if not at:
                        break
                    size = shelf[at - 1]
                    many = min(left[size], gap // size)
                    pattern.append((size, many))
                    gap -= many * size
                    at -= 1
            times = min(left[s] // m for s, m in pattern)
            out.append((times, pattern))
            for s, m in pattern:
                left[s] -= times * m
                if not left[s]:
                    for shelf in shelves[k:]:
                        i = bisect.bisect_left(shelf, s)
                        if i < len(shelf) and shelf[i] == s:
                            del shelf[i]
                            break
    return sorted(out, key=lambda p: -sum(s * m for s, m in p[1]))


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """The plan by size and rank: size, first rank, first container, items of the size in a container, offset there."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in patterns:
        offset = 0
        for size, many in pattern:
            rows.append((size, used.get(size, 0), base, many, offset))
            used[size] = used.get(size, 0) + times * many
            offset += size * many
        base += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5


def pack(sizes: DataFrame, key: str, size: str, budgets: list[tuple[int, int]], step: int = STEP) -> DataFrame:
    """Rows of budget_id, key, piece_no, first_token, n_tokens, container_id, container_offset, tier, step_group.

    ``sizes`` is read three times and should be a table or a checkpoint; ``budgets`` has (budget_id, capacity).
    """
    if any(c < 1 for _, c in budgets):
        raise ValueError("a capacity below 1")
    kinds = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("long").alias("capacity")) for b, c in budgets])
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    items = sizes.select(F.col(key).alias("key"), n.alias("whole"), F.explode(kinds).alias("b")).select("key", "whole", "b.*")
    last = F.greatest(F.ceil(F.col("whole") / F.col("capacity")), F.lit(1)) - 1
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("first_token", F.col("piece_no") * F.col("capacity"))
    items = items.withColumn("n_tokens", F.least("capacity", F.col("whole") - F.col("first_token"))).drop("whole", "capacity")
    found = items.groupBy("budget_id", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a number per budget and size
    buckets = max(BUCKETS, -(-max((r.n for r in found), default=0) // BUCKET))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece_no"), F.lit(buckets)).cast("int"))
    group = ["budget_id", "n_tokens", "bucket"]
    by_bucket = items.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    plans, longest = {}, max(c for _, c in budgets) + 1
    for k, (budget, capacity) in enumerate(budgets):
        patterns = plan({r.n_tokens: r.n for r in found if r.budget_id == budget and r.n_tokens}, capacity)
        made, places = sum(t for t, _ in patterns), _places(patterns)
        plans[budget] = (k, made, places)
    flat = [np.concatenate(x) for x in zip(*((np.int64(k) * longest + p[0], *p[1:]) for k, _, p in plans.values()))]
    starts = (flat[0] << 40) | flat[1]
    order = np.argsort(starts)
    starts, (_, first_rank, base, many, offset) = starts[order], (x[order] for x in flat)
    number = {b: k for b, (k, _, _) in plans.items()}
    n_groups = np.array([-(-made // step) or 1 for _, made, _ in plans.values()], np.int64)
    bounds = [np.array(tiers(c)[::-1]) for _, c in budgets]

    before = by_bucket.withColumn("before", F.sum("n").over(W.partitionBy("budget_id", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy("key", "piece_no")))
    ranked = ranked.join(before.select(*group, F.coalesce("before", F.lit(0)).alias("before")), group)
    ranked = ranked.select("budget_id", "key", "piece_no", "first_token", "n_tokens", (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank"))
    fields = "piece_no int, first_token long, n_tokens long, container_id long, container_offset long, tier int, step_group long"
    schema = T.StructType([ranked.schema["budget_id"], sizes.schema[key], *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.array([number[x] for x in batch.column("budget_id").to_pylist()], np.int64)
            tokens, rank = (batch.column(c).to_numpy() for c in ("n_tokens", "rank"))
            none = tokens == 0
            at = np.maximum(np.searchsorted(starts, ((b * longest + tokens) << 40) | rank, "right") - 1, 0)
            if len(starts):
                nth = rank - first_rank[at]
                container, within = base[at] + nth // many[at], offset[at] + nth % many[at] * tokens
            else:
                container = within = np.zeros(len(rank), np.int64)
            turn, seat = np.divmod(container, n_groups[b])
            step_group = np.where(turn % 2 == 0, seat, n_groups[b] - 1 - seat)
            tier = np.zeros(len(rank), np.int32)
            for k, ends in enumerate(bounds):
                own = b == k
                tier[own] = len(ends) - 1 - np.searchsorted(ends, tokens[own])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("budget_id"),
                    batch.column("key"),
                    batch.column("piece_no").cast(pa.int32()),
                    batch.column("first_token"),
                    batch.column("n_tokens"),
                    *(pa.array(x, mask=none) for x in (container, within, tier, step_group)),
                ],
                names,
            )

    return ranked.mapInArrow(place, schema)
