"""Hierarchies of scopes too large for one task, by joins; the rows are those of ``hierarchy.py``.

Everything works on keyed rows (scope, node): each step is a grouping that combines before its shuffle or a join that a
hot node can't overload, and is written, so nothing is ever held for a whole scope. Only what depends on the level above
or below goes level by level, and each row is then sent once, to the level that needs it.

1. Nodes that no cycle can pass are peeled off. What stays is split in one task where it is small enough, else coloured:
   each node takes the smallest name that reaches it, and those that also reach their colour's owner are its cycle; then
   what is left is coloured again. Cycles become single steps.
2. Depth is the number of rounds in which a step still has a parent above it. From the deepest level up, each step adds
   its size to its deepest parent; the largest child continues the chain. Chains are labelled by doubling pointers.
3. Paths along the forest: each chain has the path to its first step, found in as many rounds as chains hang on one
   another (at most the logarithm of the size); a step's path is that and a segment of its own chain.
4. Descendants are chain intervals, merged from the deepest level up. Ways from the roots are segments between steps with
   several parents; they and the roots are sent from the top down.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.runtime import checkpointed, new_folder, slices


class Shelf:
    """A table in the shared folder, written level by level; what one level writes may be meant for several others."""

    def __init__(self, spark: SparkSession, fields: list[T.StructField]) -> None:
        self.spark, self.schema, self.path = spark, T.StructType(fields), new_folder(spark)

    def put(self, level: int, rows: DataFrame, to: str | None = None) -> None:
        rows = rows.select(*self.schema.names, F.lit(level).alias("to") if to is None else F.col(to).cast("int").alias("to"))
        rows.write.mode("overwrite").partitionBy("to").parquet(f"{self.path}/at={level}")

    def get(self, level: int | None = None) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("at", T.IntegerType()), T.StructField("to", T.IntegerType())])
        rows = self.spark.read.schema(whole).option("basePath", self.path).parquet(self.path)
        return (rows if level is None else rows.filter(F.col("to") == level)).select(*self.schema.names)


def wide_hierarchy(links: DataFrame, keys: list[str], emit: str, bound: int) -> DataFrame:
    """As ``hierarchy``, for links (keys, child, parent) of large scopes; keys are never null."""
    links = checkpointed(links.select(*keys, "child", "parent").distinct())
    cycles = checkpointed(cycles_of(links, keys, bound))
    if emit == "cycles":
        return cycles
    nodes = links.select(*keys, F.col("child").alias("node")).unionByName(links.select(*keys, F.col("parent").alias("node"))).distinct()
    step = checkpointed(nodes.join(cycles, [*keys, "node"], "left").select(*keys, "node", "cycle", F.coalesce("cycle", "node").alias("step")))
    on = lambda side: step.select(*keys, F.col("node").alias(side), F.col("step").alias(f"{side}_step"))
    dag = links.join(on("child"), [*keys, "child"]).join(on("parent"), [*keys, "parent"]).filter("child_step <> parent_step")
    dag = checkpointed(dag.select(*keys, F.col("child_step").alias("child"), F.col("parent_step").alias("parent")).distinct())
    forest = Forest(dag, _levels(dag, step.select(*keys, "step").distinct(), keys), keys)
    if emit == "paths":
        return forest.with_members(_paths(forest, cycles), step).select(*keys, "node", "path_no", "root", "path", "cycle_steps")
    weight = step.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("members"))
    reach = _intervals(forest)
    chains = checkpointed(forest.chains(weight))
    if emit == "descendants":
        rest = F.explode(F.slice("names", F.col("place") + 1, F.size("names"))).alias("below")
        below = reach.join(chains, [*keys, "chain"]).select(*keys, "step", rest)
        members = step.select(*keys, F.col("step").alias("below"), F.col("node").alias("descendant"))
        return forest.with_members(below, step).join(members, [*keys, "below"]).select(*keys, "node", "descendant")
    count = reach.join(chains, [*keys, "chain"]).groupBy(*keys, "step").agg(F.sum(F.get("rest", F.col("place"))).alias("n"))
    out = forest.labels.join(_upward(forest, chains), [*keys, "chain"]).join(_roots(forest), [*keys, "step"]).join(count, [*keys, "step"], "left")
    path = F.concat("before", F.slice("names", F.lit(1), F.col("place") + 1)).alias("path")
    out = forest.with_members(out.select(*keys, "step", "depth", "roots", path, "chain", F.col("place").alias("chain_pos"), F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants")), step)
    return out.select(*keys, "node", "cycle", "depth", "roots", "path", "chain", "chain_pos", "n_descendants")


# --- cycles -----------------------------------------------------------------------------------------------------------


def _ends(links: DataFrame, keys: list[str]) -> DataFrame:
    """Links both of whose ends have a link further on."""
    sources = links.select(*keys, F.col("child").alias("parent")).distinct()
    targets = links.select(*keys, F.col("parent").alias("child")).distinct()
    return links.join(sources, [*keys, "parent"], "left_semi").join(targets, [*keys, "child"], "left_semi")


def cycles_of(links: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """keys, node, cycle of nodes on cycles. What peeling leaves is split in tasks if it has at most ``bound`` links."""
    parts = []
    loops = links.filter("child = parent").select(*keys, F.col("child").alias("node"))
    rest = links.filter("child <> parent")
    n = rest.count()
    while n:
        while True:
            rest = checkpointed(_ends(rest, keys))
            m = rest.count()
            if m == n:
                break
            n = m
        if 0 < n <= bound:
            parts.append(_near_cycles(rest, keys))
            break
        if not n:
            break
        nodes = rest.select(*keys, F.col("child").alias("node")).distinct()
        colour = _least(rest, nodes.withColumn("c", F.col("node")), keys, "child", "parent")
        of = lambda side: colour.select(*keys, F.col("node").alias(side), F.col("c").alias(f"{side}_c"))  # noqa: B023, E731
        inner = rest.join(of("child"), [*keys, "child"]).join(of("parent"), [*keys, "parent"]).filter("child_c = parent_c")
        inner = checkpointed(inner.select(*keys, "child", "parent", F.col("child_c").alias("c")))
        # Of a colour, those that reach its owner; only those found last are followed further.
        front = reached = checkpointed(colour.filter("node = c").select(*keys, "node", "c"))
        while True:
            more = inner.join(front.select(*keys, F.col("node").alias("parent"), "c"), [*keys, "parent", "c"], "left_semi").select(*keys, F.col("child").alias("node"), "c").distinct()
            front = checkpointed(more.join(reached, [*keys, "node", "c"], "left_anti"))
            if front.isEmpty():
                break
            reached = checkpointed(reached.unionByName(front))
        parts.append(reached.select(*keys, "node", F.col("c").alias("cycle")))
        gone = reached.select(*keys, "node")
        rest = checkpointed(rest.join(gone.withColumnRenamed("node", "child"), [*keys, "child"], "left_anti").join(gone.withColumnRenamed("node", "parent"), [*keys, "parent"], "left_anti"))
        n = rest.count()
    parts = [p.join(p.groupBy(*keys, "cycle").count().filter("count > 1").select(*keys, "cycle"), [*keys, "cycle"], "left_semi").select(*keys, "node", "cycle") for p in parts]
    found = reduce(DataFrame.unionByName, parts) if parts else loops.withColumn("cycle", F.col("node")).limit(0)
    alone = loops.join(found, [*keys, "node"], "left_anti").withColumn("cycle", F.col("node"))
    return found.unionByName(alone)


def _near_cycles(links: DataFrame, keys: list[str]) -> DataFrame:
    from verdigraph.operators.hierarchy import SLICE, _rows

    fields = T.StructType([*[links.schema[k] for k in keys], T.StructField("node", T.StringType()), T.StructField("cycle", T.StringType())])
    names = fields.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE, keys):
            yield from _rows(part, keys, "cycles", names)

    return links.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, fields)


def _least(links: DataFrame, colour: DataFrame, keys: list[str], source: str, target: str) -> DataFrame:
    """The smallest colour that reaches each node along the links."""
    colour = checkpointed(colour)
    while True:
        sent = links.join(colour.select(*keys, F.col("node").alias(source), "c"), [*keys, source]).select(*keys, F.col(target).alias("node"), "c")
        new = checkpointed(colour.unionByName(sent).groupBy(*keys, "node").agg(F.min("c").alias("c")))
        if new.join(colour, [*keys, "node", "c"], "left_anti").isEmpty():
            return new
        colour = new


# --- components -------------------------------------------------------------------------------------------------------


def contracted(links: DataFrame, keys: list[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of contraction of links (keys, a, b): (the links that are left, moves (keys, a, to)).

    Each name joins its neighbour of the least hash, where that is less than its own; the hash is another one each turn.
    About half of the names of every component go, stars and chains alike, by a grouping that combines before its shuffle
    and by joins.
    """
    on = [*keys, "a"]
    ways = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    luck = {c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x")) for c in "ab"}
    step = ways.groupBy(*on).agg(F.min(luck["b"]).alias("m")).select(*on, F.least(luck["a"], "m").getField("x").alias("to"))
    step = checkpointed(step)
    moved = links.join(step, on).select(*keys, F.col("to").alias("a"), "b")
    moved = moved.join(step.select(*keys, F.col("a").alias("b"), F.col("to").alias("c")), [*keys, "b"]).select(*keys, F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))
    return checkpointed(moved.filter("a <> b").distinct()), step


def relabelled(names: DataFrame, steps: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, a, b of names (keys, a): b is the smallest name of those that the moves bring to one place."""
    label = names.select(*keys, "a", F.col("a").alias("at"))
    for step in steps:
        label = label.join(step.select(*keys, F.col("a").alias("at"), "to"), [*keys, "at"], "left").select(*keys, "a", F.coalesce("to", "at").alias("at"))
    label = checkpointed(label)
    least = label.groupBy(*keys, "at").agg(F.min("a").alias("b"))
    return label.join(least, [*keys, "at"]).select(*keys, "a", "b")


# --- heavy paths ------------------------------------------------------------------------------------------------------


def _levels(dag: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, depth: the longest way down from a root."""
    level, shelf, depth = checkpointed(steps), Shelf(dag.sparkSession, [*steps.schema.fields, T.StructField("depth", T.IntegerType())]), 0
    links = dag
    while True:
        below = checkpointed(links.select(*keys, F.col("child").alias("step")).distinct())
        shelf.put(depth, level.join(below, [*keys, "step"], "left_anti").withColumn("depth", F.lit(depth)))
        if below.isEmpty():
            return shelf.get()
        links = checkpointed(links.join(below.withColumnRenamed("step", "parent"), [*keys, "parent"], "left_semi"))
        level, depth = below, depth + 1


class Forest:
    """Steps in chains: ``labels`` has keys, step, depth, above, chain, place; ``links`` the dag's, with both ends' labels."""

    def __init__(self, dag: DataFrame, levels: DataFrame, keys: list[str]) -> None:
        self.keys, self.dag = keys, dag
        deep = levels.select(*keys, F.col("step").alias("parent"), F.col("depth").alias("d"))
        best = F.min(F.struct(-F.col("d"), F.col("parent"))).alias("m")  # the deepest parent; of those, the first
        choice = dag.join(deep, [*keys, "parent"]).groupBy(*keys, "child").agg(best, F.count(F.lit(1)).alias("parents"))
        choice = choice.select(*keys, F.col("child").alias("step"), F.col("m.parent").alias("above"), "parents")
        placed = checkpointed(levels.join(choice, [*keys, "step"], "left"))
        self.last = placed.agg(F.max("depth")).first()[0] or 0
        heavy = self._heavy(placed)
        placed = placed.join(heavy, [*keys, "above"], "left")
        on = F.coalesce(F.col("heavy") == F.col("step"), F.lit(False))
        placed = checkpointed(placed.select(*keys, "step", "depth", "above", "parents", on.alias("on")))
        chain = self._doubled(placed.select(*keys, "step", F.when(F.col("on"), F.col("above")).otherwise(F.col("step")).alias("up"), F.col("on").cast("int").alias("far")))
        # Where a way comes in: the nearest step of the chain, itself or above, with other parents than its chain's, or none.
        one = F.col("on") & (F.col("parents") == 1)
        entry = self._doubled(placed.select(*keys, "step", F.when(one, F.col("above")).otherwise(F.col("step")).alias("up"), one.cast("int").alias("far")))
        labels = placed.join(chain.select(*keys, "step", F.col("up").alias("chain"), F.col("far").alias("place")), [*keys, "step"])
        labels = labels.join(entry.select(*keys, "step", F.col("up").alias("entry"), F.col("far").alias("since")), [*keys, "step"])
        self.labels = checkpointed(labels.select(*keys, "step", "depth", "above", "chain", "place", "entry", "since"))

    def _heavy(self, placed: DataFrame) -> DataFrame:
        """keys, above, heavy: the child that continues a step's chain, by subtree sizes."""
        keys = self.keys
        by_depth = Shelf(placed.sparkSession, [placed.schema[c] for c in (*keys, "step", "above")])
        by_depth.put(0, placed, "depth")
        sizes = Shelf(placed.sparkSession, [*by_depth.schema.fields, T.StructField("size", T.LongType())])
        for depth in range(self.last, -1, -1):
            here = by_depth.get(depth)
            if depth == self.last:
                sizes.put(depth, here.withColumn("size", F.lit(1).cast("long")))
                continue
            carried = sizes.get(depth + 1).groupBy(*keys, F.col("above").alias("step")).agg(F.sum("size").alias("sub"))
            sizes.put(depth, here.join(carried, [*keys, "step"], "left").withColumn("size", (F.lit(1) + F.coalesce("sub", F.lit(0))).cast("long")))
        best = F.min(F.struct(-F.col("size"), F.col("step"))).alias("m")
        return sizes.get().filter("above is not null").groupBy(*keys, "above").agg(best).select(*keys, "above", F.col("m.step").alias("heavy"))

    def _doubled(self, pointers: DataFrame) -> DataFrame:
        """keys, step, up, far: where pointers end that lead to another step or to themselves, and how far that is."""
        keys, here = self.keys, checkpointed(pointers)
        while True:
            there = here.filter("far > 0").select(*keys, F.col("step").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
            moved = here.join(there, [*keys, "up"], "left")
            if moved.filter("next is not null").isEmpty():
                return here
            here = checkpointed(moved.select(*keys, "step", F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))

    def chains(self, weight: DataFrame | None = None) -> DataFrame:
        """keys, chain, names in order, and (with weights) the members from each place on. A chain is no longer than the hierarchy is deep."""
        keys, rows = self.keys, self.labels.select(*self.keys, "chain", "place", "step")
        if weight is None:
            in_order = F.array_sort(F.collect_list(F.struct("place", "step")))
            return rows.groupBy(*keys, "chain").agg(in_order.alias("x")).select(*keys, "chain", F.col("x.step").alias("names"))
        rows = rows.join(weight, [*keys, "step"])
        rows = rows.withColumn("rest", F.sum("members").over(W.partitionBy(*keys, "chain").orderBy(F.desc("place"))))
        in_order = F.array_sort(F.collect_list(F.struct("place", "step", "rest")))
        return rows.groupBy(*keys, "chain").agg(in_order.alias("x")).select(*keys, "chain", F.col("x.step").alias("names"), F.col("x.rest").alias("rest"))

    def with_members(self, rows: DataFrame, step: DataFrame) -> DataFrame:
        return rows.join(step, [*self.keys, "step"])


def _intervals(forest: Forest) -> DataFrame:
    """keys, step, chain, place: the step has below it the rest of the chain from there on."""
    keys = forest.keys
    child = forest.labels.select(*keys, F.col("step").alias("child"), "chain", "place", "depth")
    up = forest.labels.select(*keys, F.col("step").alias("parent"), F.col("depth").alias("parent_depth"))
    links = forest.dag.join(child, [*keys, "child"]).join(up, [*keys, "parent"])
    rows = [*[forest.dag.schema[k] for k in keys], T.StructField("step", T.StringType()), T.StructField("chain", T.StringType()), T.StructField("place", T.IntegerType())]
    spark = forest.dag.sparkSession
    ways = Shelf(spark, [*rows[: len(keys)], *[T.StructField(c, T.StringType()) for c in ("child", "parent", "chain")], T.StructField("place", T.IntegerType()), T.StructField("parent_depth", T.IntegerType())])
    ways.put(0, links, "depth")
    sent, held = Shelf(spark, rows), Shelf(spark, rows)
    for depth in range(forest.last, -1, -1):
        here = None
        if depth < forest.last:
            held.put(depth, sent.get(depth).groupBy(*keys, "step", "chain").agg(F.min("place").alias("place")))
            here = held.get(depth).withColumnRenamed("step", "child")
        out = ways.get(depth)
        own = out.select(*keys, F.col("parent").alias("step"), "chain", "place", "parent_depth")
        if here is not None:
            own = own.unionByName(out.select(*keys, "child", F.col("parent").alias("step"), "parent_depth").join(here, [*keys, "child"]).select(*own.columns))
        sent.put(depth, own, "parent_depth")
    if not forest.last:
        held.put(0, spark.createDataFrame([], held.schema))
    return held.get()


def _roots(forest: Forest) -> DataFrame:
    """keys, step, roots."""
    keys, spark = forest.keys, forest.dag.sparkSession
    text = lambda name: T.StructField(name, T.StringType())
    scope = [forest.dag.schema[k] for k in keys]
    up = forest.labels.select(*keys, F.col("step").alias("parent"), "depth")
    down = forest.labels.select(*keys, F.col("step").alias("child"), F.col("depth").alias("child_depth"))
    ways = Shelf(spark, [*scope, text("child"), text("parent"), T.StructField("child_depth", T.IntegerType())])
    ways.put(0, forest.dag.join(up, [*keys, "parent"]).join(down, [*keys, "child"]), "depth")
    sent, held = Shelf(spark, [*scope, text("step"), text("root")]), Shelf(spark, [*scope, text("step"), text("root")])
    held.put(0, forest.labels.filter("depth = 0").select(*keys, "step", F.col("step").alias("root")))
    for depth in range(forest.last + 1):
        if depth:
            held.put(depth, sent.get(depth).distinct())
        here = held.get(depth).withColumnRenamed("step", "parent")
        sent.put(depth, ways.get(depth).join(here, [*keys, "parent"]).select(*keys, F.col("child").alias("step"), "root", "child_depth"), "child_depth")
    return held.get().groupBy(*keys, "step").agg(F.array_sort(F.collect_set("root")).alias("roots"))


def _upward(forest: Forest, chains: DataFrame) -> DataFrame:
    """keys, chain, names, before: the path to each chain's first step, along the forest; chains that hang on known ones in each round."""
    keys = forest.keys
    first = forest.labels.filter("place = 0").select(*keys, "chain", "above")
    on = forest.labels.select(*keys, F.col("step").alias("above"), F.col("chain").alias("upper"), F.col("place").alias("there"))
    hung = checkpointed(first.join(on, [*keys, "above"]).select(*keys, "chain", "upper", "there"))
    known = checkpointed(first.filter("above is null").select(*keys, "chain", F.array().cast("array<string>").alias("before")).join(chains, [*keys, "chain"]))
    parts = [known]
    while True:
        upper = parts[-1].select(*keys, F.col("chain").alias("upper"), F.concat("before", "names").alias("passed"), F.size("before").alias("n"))
        found = hung.join(upper, [*keys, "upper"]).select(*keys, "chain", F.slice("passed", F.lit(1), F.col("n") + F.col("there") + 1).alias("before"))
        found = checkpointed(found.join(chains, [*keys, "chain"]).select(*known.columns))
        if found.isEmpty():
            return reduce(DataFrame.unionByName, parts).select(*keys, "chain", "names", "before")
        parts.append(found)


def _paths(forest: Forest, cycles: DataFrame) -> DataFrame:
    """keys, step, path_no, root, path, cycle_steps of all ways down from a root.

    Ways are kept at entries only, numbered through their parents in order; other steps add a segment of their chain.
    """
    keys, spark = forest.keys, forest.dag.sparkSession
    labels = forest.labels
    chains = forest.chains()
    segment = F.slice("names", F.col("place") - F.col("since") + 2, F.col("since")).alias("segment")  # after the entry, to the step
    parts = checkpointed(labels.join(chains, [*keys, "chain"]).select(*keys, "step", "entry", "depth", segment))
    entries = labels.filter("step = entry").select(*keys, F.col("step").alias("child"), F.col("depth").alias("child_depth"))
    up = parts.select(*keys, F.col("step").alias("parent"), "entry", "segment")
    at = labels.select(*keys, F.col("step").alias("entry"), "depth")
    scope = [forest.dag.schema[k] for k in keys]
    text = lambda name: T.StructField(name, T.StringType())
    names = lambda name: T.StructField(name, T.ArrayType(T.StringType()))
    ways = Shelf(spark, [*scope, text("child"), text("parent"), text("entry"), names("segment"), T.StructField("child_depth", T.IntegerType())])
    ways.put(0, forest.dag.join(entries, [*keys, "child"]).join(up, [*keys, "parent"]).join(at, [*keys, "entry"]), "depth")
    nth = T.StructField("path_no", T.LongType())
    sent, held = Shelf(spark, [*scope, text("step"), text("parent"), nth, names("path")]), Shelf(spark, [*scope, text("step"), nth, names("path")])
    held.put(0, labels.filter("depth = 0").select(*keys, "step", F.lit(0).cast("long").alias("path_no"), F.array("step").alias("path")))
    for depth in range(forest.last + 1):
        if depth:
            come = sent.get(depth)
            count = come.groupBy(*keys, "step", "parent").agg(F.count(F.lit(1)).alias("n"))
            before = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "step").orderBy("parent").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
            count = count.select(*keys, "step", "parent", before)
            held.put(depth, come.join(count, [*keys, "step", "parent"]).withColumn("path_no", F.col("path_no") + F.col("before")))
        here = held.get(depth).withColumnRenamed("step", "entry")
        on = ways.get(depth).join(here, [*keys, "entry"])
        sent.put(depth, on.select(*keys, F.col("child").alias("step"), "parent", "path_no", F.concat("path", "segment", F.array("child")).alias("path"), "child_depth"), "child_depth")
    whole = held.get().withColumnRenamed("step", "entry").join(parts, [*keys, "entry"])
    whole = whole.select(*keys, "step", "path_no", F.concat("path", "segment").alias("path"))
    marked = cycles.select(*keys, F.col("cycle").alias("passed")).distinct()
    spread = whole.select(*keys, "step", "path_no", F.posexplode("path").alias("place", "passed")).join(marked, [*keys, "passed"], "left_semi")
    places = spread.groupBy(*keys, "step", "path_no").agg(F.array_sort(F.collect_list("place")).alias("places"))
    whole = whole.join(places, [*keys, "step", "path_no"], "left")
    return whole.select(*keys, "step", "path_no", F.col("path")[0].alias("root"), "path", F.coalesce("places", F.array().cast("array<int>")).alias("cycle_steps"))
