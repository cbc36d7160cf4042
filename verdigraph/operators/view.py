"""View models: a graph as numbered nodes, links, groups and relations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigraph.functions.text import slug
from verdigraph.operators.extract import array_triples
from verdigraph.runtime import by_size, checkpointed

NO_GROUP = "—"
#: Rows of a scope that one task numbers.
BOUND = 2_000_000


def curated_parts(graphs: DataFrame, scope: list[str], types: DataFrame) -> dict[str, DataFrame]:
    """Groups, edges (with pos), relations and flags of curated graphs. ``types`` has key, ord, verbose and flags.

    A relation's key is its own (a field that may be missing), else that of its verbose name, else a slug of that name.
    """
    domains = graphs.select(*scope, F.posexplode(F.map_entries("concepts_by_domains")).alias("d", "e"))
    listed = domains.select(*scope, "d", F.col("e.key").alias("group"), F.explode("e.value").alias("name")).filter("name is not null")
    group_of = listed.groupBy(*scope, "name").agg(F.min(F.struct("d", "group")).alias("m")).select(*scope, "name", F.col("m.group").alias("group"))
    groups = graphs.select(*scope, F.posexplode("relations").alias("rel", "g")).filter("g is not null")
    by_name = types.groupBy("verbose").agg(F.max_by("key", "ord").alias("known"))
    own = F.col("g.key") if "key" in graphs.schema["relations"].dataType.elementType.names else F.lit(None).cast("string")
    details = groups.select(*scope, "rel", own.alias("own"), F.col("g.details").alias("details"), F.coalesce("g.details.verbose", F.lit("")).alias("verbose"))
    keyed = details.join(by_name, "verbose", "left").select(*scope, "rel", "details", F.coalesce(F.nullif("own", F.lit("")), "known", slug(F.col("verbose"))).alias("key"))
    flags = types.select("key", *[F.col(c).alias(f"t_{c}") for c in ("verbose", "directed", "acyclic", "use_in_embedding")])
    first = {"verbose": F.translate("key", "_", " "), "directed": F.lit(True), "acyclic": F.lit(False), "use_in_embedding": F.lit(True)}
    meta = keyed.join(flags, "key", "left")
    relations = meta.select(*scope, "rel", "key", *[F.coalesce(F.col(f"details.{c}"), F.col(f"t_{c}"), d).alias(c) for c, d in first.items()])
    data = groups.select(*scope, "rel", F.posexplode(F.map_entries("g.relations_data")).alias("s", "e"))
    data = data.select(*scope, "rel", "s", F.col("e.key").alias("source"), F.posexplode("e.value").alias("t", "target")).filter("target is not null")
    edges = data.select(*scope, "rel", F.struct("rel", "s", "t").alias("pos"), "source", "target")
    flagged = graphs.select(*scope, F.explode("generic_non_taggable_concepts").alias("name")).filter("name is not null").distinct()
    return {"group_of": group_of, "edges": edges, "relations": relations, "flagged": flagged}


def flat_parts(graphs: DataFrame, scope: list[str], by: list[str], types: DataFrame, names: DataFrame, group_of: DataFrame | None) -> dict[str, DataFrame]:
    """The same of flat graphs, and their names. ``types`` also has ``by`` (columns of ``graphs``, as the vocabulary).

    A graph may be there more than once; ``group_of`` isn't needed for links and relations.
    """
    raw = array_triples(graphs, "relations", *scope, *by).withColumnRenamed("relation", "key")
    said = graphs.select(*scope, *by, F.posexplode("edges").alias("pos", "key")).filter("key is not null").withColumn("tier", F.lit(0))
    keys = said.unionByName(raw.select(*scope, *by, "pos", "key", F.lit(1).alias("tier"))).groupBy(*scope, *by, "key").agg(F.min(F.struct("tier", "pos")).alias("o"))
    flags = {"verbose": F.translate("key", "_", " "), "directed": F.lit(True), "acyclic": F.lit(False), "use_in_embedding": F.lit(True)}
    known = types.select(*by, "key", *[F.col(c).alias(f"t_{c}") for c in flags])
    number = (F.row_number().over(W.partitionBy(*scope).orderBy("o")) - 1).alias("rel")  # a graph has few kinds of relations
    relations = keys.join(known, [*by, "key"], "left").select(*scope, number, "key", *[F.coalesce(f"t_{c}", d).alias(c) for c, d in flags.items()])
    relations = checkpointed(relations)
    edges = raw.select(*scope, "pos", "source", "target", "key").join(relations.select(*scope, "key", "rel"), [*scope, "key"]).drop("key")
    return {"names": names, "group_of": group_of, "edges": edges, "relations": relations, "flagged": names.limit(0)}


def numbered(rows: DataFrame, scope: list[str], order: list[str], name: str, bound: int = BOUND) -> DataFrame:
    """``rows`` (a table or checkpoint) with their number in their scope, from 0, by ``order``, which must tell them apart.

    A scope above ``bound`` rows is sorted by ranges, so it is spread over tasks, and each range's numbers begin after
    those of the ranges before it. Of these, only scopes torn by ranges need to be known: two for each range at most.
    """
    near, wide, large = by_size(rows, scope, bound)
    near = near.withColumn(name, (F.row_number().over(W.partitionBy(*scope).orderBy(*order)) - 1).cast("long"))
    if wide is None:
        return near
    ranges = max(2, -(-wide.count() // bound))
    ranged = wide.repartitionByRange(ranges, "large", *order).sortWithinPartitions("large", *order)
    at = checkpointed(ranged.withColumns({"range": F.spark_partition_id(), "seq": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    first = at.groupBy("large", "range").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("large").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = first.select("large", "range", (before - F.col("first")).alias("shift"))
    return near.unionByName(at.join(first, ["large", "range"]).withColumn(name, F.col("seq") + F.col("shift")).select(*near.columns))


class ViewModel:
    """groups, nodes, links, relations and isolated (counts) of graphs, each worked out when asked for.

    Numbers start at 0 within a graph: nodes by name, groups by size, relations as they come. Links to itself are left
    out, and repeated ones, a symmetric relation's in either direction, but for the first; ``pos`` orders links as they
    come. ``parts`` may have ``names``, those of all ends and groups; ``shared`` keeps what several views need.
    """

    def __init__(self, parts: dict[str, DataFrame], scope: list[str], shared: bool = False) -> None:
        self.parts, self.scope = parts, scope
        self.keep = checkpointed if shared else lambda df: df

    def __getitem__(self, which: str) -> DataFrame:
        return getattr(self, which)

    @cached_property
    def names(self) -> DataFrame:
        names = self.parts.get("names")
        if names is None:
            ends = self.parts["edges"].select(*self.scope, F.explode(F.array("source", "target")).alias("name"))
            names = self.parts["group_of"].select(*self.scope, "name").unionByName(ends).distinct()
        return checkpointed(names)

    @cached_property
    def numbers(self) -> DataFrame:
        return self.keep(numbered(self.names, self.scope, ["name"], "idx")).withColumn("idx", F.col("idx").cast("int"))

    @cached_property
    def named(self) -> DataFrame:
        known = self.numbers.join(self.parts["group_of"], [*self.scope, "name"], "left")
        return self.keep(known.withColumn("group", F.coalesce("group", F.lit(NO_GROUP))))

    @cached_property
    def groups(self) -> DataFrame:
        sizes = self.named.groupBy(*self.scope, "group").agg(F.count(F.lit(1)).alias("count"))
        return sizes.select(*self.scope, (F.row_number().over(W.partitionBy(*self.scope).orderBy(F.desc("count"), "group")) - 1).alias("idx"), "group", "count")

    @cached_property
    def nodes(self) -> DataFrame:
        groups = self.groups.select(*self.scope, "group", F.col("idx").alias("group_idx"))
        flagged = self.parts["flagged"].withColumn("flag", F.lit(1))
        out = self.named.join(groups, [*self.scope, "group"]).join(flagged, [*self.scope, "name"], "left")
        return out.select(*self.scope, "idx", "name", "group_idx", F.coalesce("flag", F.lit(0)).alias("flag"))

    @cached_property
    def kinds(self) -> DataFrame:
        """(scope, rel, r, directed): of relations that share a key, the last has all edges."""
        last = F.max_by(F.struct(F.col("rel").alias("r"), "directed"), "rel").over(W.partitionBy(*self.scope, "key"))
        return self.parts["relations"].select(*self.scope, "rel", "key", last.alias("l")).select(*self.scope, "rel", "key", "l.r", "l.directed")

    @cached_property
    def real(self) -> DataFrame:
        """(scope, r, pos, source, target): links by name."""
        edges = self.parts["edges"].filter("source <> target").join(self.kinds.drop("key"), [*self.scope, "rel"])
        a = F.when(F.col("directed"), F.col("source")).otherwise(F.least("source", "target")).alias("a")
        b = F.when(F.col("directed"), F.col("target")).otherwise(F.greatest("source", "target")).alias("b")
        first = edges.groupBy(*self.scope, "r", a, b).agg(F.min(F.struct("pos", "source", "target")).alias("m"))
        return self.keep(first.select(*self.scope, "r", "m.pos", "m.source", "m.target"))

    @cached_property
    def links(self) -> DataFrame:
        out = self.real
        for end in ("source", "target"):
            out = out.join(self.numbers.select(*self.scope, F.col("name").alias(end), F.col("idx").alias(end[0])), [*self.scope, end])
        return out.select(*self.scope, "s", "t", "r", "pos")

    @cached_property
    def relations(self) -> DataFrame:
        count = self.real.groupBy(*self.scope, "r").agg(F.count(F.lit(1)).alias("n"))
        known = self.parts["relations"].join(self.kinds.select(*self.scope, "rel", "r"), [*self.scope, "rel"]).join(count, [*self.scope, "r"], "left")
        return known.select(*self.scope, F.col("rel").alias("idx"), "key", "verbose", "directed", "acyclic", "use_in_embedding", F.coalesce("n", F.lit(0)).alias("count"))

    @cached_property
    def isolated(self) -> DataFrame:
        met = self.real.select(*self.scope, F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("met", F.lit(1))
        return self.names.join(met, [*self.scope, "name"], "left").groupBy(*self.scope).agg(F.count_if(F.col("met").isNull()).alias("isolated"))
