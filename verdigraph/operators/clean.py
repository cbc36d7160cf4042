"""Merging names: mechanically, then by proposed aliases and drops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigraph.functions.text import name_key, preference


def deterministic_merge(names: DataFrame, scope: list[str], qualifier: str | None = None, suffixes: tuple[str, ...] = ("s",)) -> DataFrame:
    """(scope, name, representative): of the names of one key the preferred one stands for all.

    ``names`` is distinct, so a key's window holds the spellings of one name.
    """
    keyed = names.select(*scope, "name", name_key(F.col("name"), qualifier, suffixes).alias("key"))
    best = F.min(preference(F.col("name"))).over(W.partitionBy(*scope, "key"))
    return keyed.withColumn("best", best).select(*scope, "name", F.col("best.name").alias("representative"))


def evidence(found: DataFrame, scope: list[str], most: int, merged: DataFrame | None = None) -> DataFrame:
    """(scope, name, nth, text): the first ``most`` outgoing relations of each name, by position, ends by representative."""
    out = found.select(*scope, "pos", "source", "relation", "target")
    for end in ("source", "target") if merged is not None else ():
        to = merged.select(*scope, F.col("name").alias(end), F.col("representative").alias("r"))
        out = out.join(to, [*scope, end], "left").withColumn(end, F.coalesce("r", end)).drop("r")
    nth = F.row_number().over(W.partitionBy(*scope, "source").orderBy("pos"))
    out = out.withColumn("nth", nth).filter(F.col("nth") <= most)
    return out.select(*scope, F.col("source").alias("name"), "nth", F.concat_ws(" ", "relation", "target").alias("text"))


def node_lines(names: DataFrame, proof: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, line): a line of a prompt per name, with its evidence."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"])
    known = proof.groupBy(*scope, "name").agg(F.array_join(texts, "; ").alias("why"))
    line = F.concat(F.lit("- "), F.col("name"), F.coalesce(F.concat(F.lit("  ["), F.col("why"), F.lit("]")), F.lit("")))
    return names.select(*scope, "name").join(known, [*scope, "name"], "left").select(*scope, "name", line.alias("line"))


def alias_map(proposal: DataFrame, valid: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, target) from rows (scope, ord, canon, aliases).

    Only valid names count. A canonical name that isn't valid gives way to its first valid alias. What comes later wins;
    chains aren't followed.
    """
    listed = F.concat(F.array("canon"), F.coalesce("aliases", F.array().cast("array<string>")))
    members = proposal.select(*scope, "ord", F.posexplode(listed).alias("pos", "name"))
    members = members.join(valid.select(*scope, "name"), [*scope, "name"], "left_semi")
    first = members.groupBy(*scope, "ord").agg(F.min_by("name", "pos").alias("target"))
    return members.join(first, [*scope, "ord"]).groupBy(*scope, "name").agg(F.max_by("target", F.struct("ord", "pos")).alias("target"))


def node_map(merged: DataFrame, aliases: DataFrame, drops: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, canonical): the representative, or its alias target; null if the representative is dropped."""
    to = aliases.select(*scope, F.col("name").alias("representative"), "target")
    gone = drops.select(*scope, F.col("name").alias("representative"), F.lit(True).alias("gone")).distinct()
    out = merged.join(to, [*scope, "representative"], "left").join(gone, [*scope, "representative"], "left")
    return out.select(*scope, "name", F.when(F.col("gone").isNull(), F.coalesce("target", "representative")).alias("canonical"))


def apply_node_map(found: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Triples between canonical names, distinct; those with a dropped or empty end are gone."""
    kept = nodes.filter("canonical is not null and canonical <> ''")
    out = found.select(*scope, "source", "relation", "target")
    for end in ("source", "target"):
        out = out.join(kept.select(*scope, F.col("name").alias(end), F.col("canonical").alias("c")), [*scope, end]).withColumn(end, F.col("c")).drop("c")
    return out.select(*scope, "source", "relation", "target").distinct()


def entities(nodes: DataFrame, scope: list[str], blank: bool = False) -> DataFrame:
    """(scope, name): canonical names that remain; ``blank`` ones too if wanted."""
    return nodes.filter("canonical is not null" if blank else "canonical is not null and canonical <> ''").select(*scope, F.col("canonical").alias("name")).distinct()
