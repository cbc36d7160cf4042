"""Domains of concepts and typed groups of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile_domains(concepts: DataFrame, proposal: DataFrame, scope: list[str], unclassified: Column) -> DataFrame:
    """(scope, domain, ord, name, leftover): each concept in one domain.

    ``proposal`` has (scope, ord, domain, name). The first domain that lists a concept has it; concepts nobody lists go to
    the unclassified domain, which comes last unless it was proposed.
    """
    placed = proposal.join(concepts.select(*scope, "name"), [*scope, "name"], "left_semi")
    placed = placed.groupBy(*scope, "name").agg(F.min(F.struct("ord", "domain")).alias("d")).select(*scope, "d.domain", "d.ord", "name", F.lit(False).alias("leftover"))
    left = concepts.select(*scope, "name").join(placed, [*scope, "name"], "left_anti")
    named = placed.select(*scope, "domain", "ord").distinct().withColumn("u", unclassified).filter("domain = u").select(*scope, F.col("ord").alias("o"))
    left = left.join(named, scope, "left").select(*scope, unclassified.alias("domain"), F.col("o").alias("ord"), "name", F.lit(True).alias("leftover"))
    return placed.unionByName(left)


def non_taggable(raw: DataFrame, concepts: DataFrame, scope: list[str]) -> DataFrame:
    return raw.select(*scope, "name").join(concepts.select(*scope, "name"), [*scope, "name"], "left_semi").distinct()


def typed_relations(found: DataFrame, concepts: DataFrame, kinds: DataFrame, on: list[str], scope: list[str]) -> DataFrame:
    """(scope, on but relation, ord, relation, source, target), distinct.

    Both ends must be concepts. A relation of unknown kind is of the fallback kind, or dropped where there is none.
    ``kinds`` has ``on`` (among them relation), ord and fallback (boolean).
    """
    by = [c for c in on if c != "relation"]
    out = found
    for end in ("source", "target"):
        out = out.join(concepts.select(*scope, F.col("name").alias(end)), [*scope, end], "left_semi")
    known = kinds.select(*on, F.col("relation").alias("known"), "ord")
    rest = kinds.filter("fallback").select(*by, F.col("relation").alias("f_relation"), F.col("ord").alias("f_ord"))
    out = out.join(known, on, "left")
    out = out.join(rest, by, "left") if by else out.join(rest, F.lit(True), "left")
    out = out.withColumns({"relation": F.coalesce("known", "f_relation"), "ord": F.coalesce("ord", "f_ord")}).filter("relation is not null")
    return out.select(*scope, *[c for c in by if c not in scope], "ord", "relation", "source", "target").distinct()


def adjacency(typed: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, ord, relation, source, targets): sorted targets of each source."""
    return typed.groupBy(*scope, "ord", "relation", "source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def curated_graph(domains: DataFrame, untaggable: DataFrame, typed: DataFrame, details: DataFrame, scope: list[str]) -> DataFrame:
    """The interchange form, a row per scope: maps and arrays in order."""
    kept, left = (F.array_sort(F.collect_list(F.when(c, F.col("name")))) for c in (~F.col("leftover"), F.col("leftover")))
    one = domains.groupBy(*scope, "domain").agg(F.min(F.coalesce("ord", F.lit(1 << 30))).alias("ord"), F.concat(kept, left).alias("names"))
    in_order = lambda c: F.array_sort(F.collect_list(c))
    pick = lambda *fields: lambda x: F.struct(*[x[f].alias(f) for f in fields])
    maps = one.groupBy(*scope).agg(F.map_from_entries(F.transform(in_order(F.struct("ord", "domain", "names")), pick("domain", "names"))).alias("concepts_by_domains"))
    no = untaggable.groupBy(*scope).agg(F.array_sort(F.collect_set("name")).alias("generic_non_taggable_concepts"))
    data = adjacency(typed, scope).groupBy(*scope, "ord", "relation").agg(F.map_from_entries(in_order(F.struct("source", "targets"))).alias("relations_data"))
    data = data.join(details, "relation").groupBy(*scope).agg(F.array_agg(F.struct("ord", "details", "relations_data")).alias("g"))
    groups = F.transform(F.array_sort("g", lambda a, b: a["ord"] - b["ord"]), pick("details", "relations_data")).alias("relations")
    data = data.select(*scope, groups)
    join = (lambda a, b: a.join(b, scope, "left")) if scope else (lambda a, b: a.join(b, F.lit(True), "left"))
    return join(join(maps, no), data)
