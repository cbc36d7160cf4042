"""Concepts and triples: from model responses or raw arrays to validated sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.text import strip


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def concepts(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """Names of a JSON array: its strings, stripped, without blank ones. ``raw`` is a variant column."""
    items = df.select(*keep, F.col(raw).alias("raw")).filter(_is(F.col("raw"), "ARRAY"))
    items = items.select(*keep, F.explode(F.col("raw").try_cast("array<variant>")).alias("x")).filter(_is(F.col("x"), "STRING"))
    return items.select(*keep, strip(F.col("x").try_cast("string")).alias("name")).filter("name <> ''")


def triples(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """pos, source, relation, target of a JSON array's elements that are arrays of three strings."""
    items = df.select(*keep, F.col(raw).alias("raw")).filter(_is(F.col("raw"), "ARRAY"))
    items = items.select(*keep, F.posexplode(F.col("raw").try_cast("array<variant>")).alias("pos", "x")).filter(_is(F.col("x"), "ARRAY"))
    items = items.select(*keep, "pos", F.col("x").try_cast("array<variant>").alias("x"))
    three = (F.size("x") == 3) & F.forall("x", lambda v: _is(v, "STRING"))
    part = lambda i: F.get(F.col("x"), F.lit(i)).try_cast("string")
    return items.filter(three).select(*keep, "pos", part(0).alias("source"), part(1).alias("relation"), part(2).alias("target"))


def array_triples(df: DataFrame, raw: str, *keep: str) -> DataFrame:
    """The same from an array of arrays of strings."""
    items = df.select(*keep, F.posexplode(raw).alias("pos", "x")).filter((F.size("x") == 3) & ~F.exists("x", lambda v: v.isNull()))
    part = lambda i: F.get(F.col("x"), F.lit(i))
    return items.select(*keep, "pos", part(0).alias("source"), part(1).alias("relation"), part(2).alias("target"))


def valid_relations(raw: DataFrame, kinds: DataFrame, on: list[str], inventory: DataFrame | None = None, scope: list[str] = ()) -> DataFrame:
    """Stripped triples with two different ends, of a known kind; with an inventory (scope, name), both ends in it.

    ``kinds`` has the columns ``on``, among them relation.
    """
    parts = [strip(F.col(c)).alias(c) for c in ("source", "relation", "target")]
    rest = [c for c in raw.columns if c not in ("source", "relation", "target")]
    out = raw.select(*rest, *parts).filter("source <> '' and target <> '' and source <> target")
    out = out.join(kinds.select(*on), on, "left_semi")
    for end in ("source", "target") if inventory is not None else ():
        out = out.join(inventory.select(*scope, F.col("name").alias(end)), [*scope, end], "left_semi")
    return out


def distinct_triples(valid: DataFrame, scope: list[str]) -> DataFrame:
    return valid.select(*scope, "source", "relation", "target").distinct()


def universe(names: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name): names and all ends of triples."""
    ends = found.select(*scope, F.explode(F.array("source", "target")).alias("name"))
    return names.select(*scope, "name").unionByName(ends).distinct()


def flat_graph(names: DataFrame, found: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, entities, edges, relations): the sorted interchange form, a row per scope."""
    entities = names.groupBy(*scope).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    triple = F.array("source", "relation", "target")
    rest = found.groupBy(*scope).agg(F.array_sort(F.collect_set("relation")).alias("edges"), F.array_sort(F.collect_set(triple)).alias("relations"))
    none = F.array()
    out = entities.join(rest, scope, "left") if scope else entities.join(rest, F.lit(True), "left")
    return out.withColumns({"edges": F.coalesce("edges", none.cast("array<string>")), "relations": F.coalesce("relations", none.cast("array<array<string>>"))})
