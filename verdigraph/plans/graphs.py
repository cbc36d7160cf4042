"""Queries of the graph stages over the graph tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.functions.text import name_key, slug, strip, universal_newlines
from verdigraph.operators import chunking, clean, curate, extract, graph, view
from verdigraph.operators.hierarchy import hierarchy
from verdigraph.runtime import checkpointed, table

G = ["graph_id"]
ON = ["vocabulary", "relation"]
QUALIFIER = r"\s+in (general|practice)\b"


# --- inputs -----------------------------------------------------------------------------------------------------------


def staging(spark: SparkSession, folder: str, *columns: str, once: bool = True) -> DataFrame:
    """Staging graphs, each once; or as loaded, where what follows makes rows distinct anyway: that spares a shuffle of all arrays."""
    graphs = table(spark, folder, "knowledge_graph_partial").select("graph_id", *columns)
    return graphs.dropDuplicates(G) if once else graphs


def curated(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "knowledge_graph_autogenerated").select("graph_id", *columns).dropDuplicates(G)


def kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "relation_types").withColumnRenamed("rel_key", "relation")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """Names among the entities, as often as they are there."""
    raw = staging(spark, folder, "entities", once=False).select("graph_id", F.explode("entities").alias("name"))
    return raw.select("graph_id", strip(F.col("name")).alias("name")).filter("name <> ''")


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    return listed(spark, folder).distinct()


def relations(spark: SparkSession, folder: str, once: bool = True) -> DataFrame:
    """Valid relations: graph_id, vocabulary, pos, source, relation, target."""
    raw = extract.array_triples(staging(spark, folder, "vocabulary", "relations", once=once), "relations", "graph_id", "vocabulary")
    return extract.valid_relations(raw, kinds(spark, folder), ON)


def names(spark: SparkSession, folder: str) -> DataFrame:
    return extract.universe(listed(spark, folder), relations(spark, folder, once=False), G)


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return clean.deterministic_merge(names(spark, folder), G)


def last_response(spark: SparkSession, folder: str) -> DataFrame:
    """The last response of each graph that has a proposal: graph_id, canonical, dropped."""
    good = table(spark, folder, "clean").filter("canonical is not null")
    order = F.struct("batch_no", "attempt", "response_id")
    return good.groupBy("graph_id").agg(F.max_by(F.struct("canonical", "dropped"), order).alias("r")).select("graph_id", "r.*")


def proposal(responses: DataFrame, *keep: str) -> DataFrame:
    return responses.select(*keep, F.posexplode(F.map_entries("canonical")).alias("ord", "e")).select(*keep, "ord", F.col("e.key").alias("canon"), F.col("e.value").alias("aliases"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    said = last_response(spark, folder)
    own = merged(spark, folder)
    valid = own.select("graph_id", F.col("representative").alias("name")).distinct()
    aliases = clean.alias_map(proposal(said, "graph_id"), valid, G)
    drops = said.select("graph_id", F.explode("dropped").alias("name")).filter("name is not null")
    return clean.node_map(own, aliases, drops, G)


def typed(spark: SparkSession, folder: str) -> DataFrame:
    raw = extract.array_triples(staging(spark, folder, "vocabulary", "relations", once=False), "relations", "graph_id", "vocabulary")
    return curate.typed_relations(raw, names(spark, folder), kinds(spark, folder), ON, G)


# --- queries ----------------------------------------------------------------------------------------------------------


def chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "builder_config").select("config_id", "chunk_size").orderBy("config_id").collect()  # a table of fixed size
    each = F.array(*[F.struct(F.lit(c).alias("config_id"), F.lit(s).alias("chunk_size")) for c, s in sizes])
    docs = table(spark, folder, "documents").select("doc_id", universal_newlines(F.col("text")).alias("text"))
    return chunking.chunk_text(docs, "text", F.col("chunk_size"), each).select("config_id", "doc_id", "chunk_no", "chunk")


def name_keys(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("name")
    return names(spark, folder).select("graph_id", "name", name_key(n).alias("key"), name_key(n, QUALIFIER).alias("qualified"), slug(n).alias("slug"))


def relations_in_inventory(spark: SparkSession, folder: str) -> DataFrame:
    raw = extract.array_triples(staging(spark, folder, "vocabulary", "relations"), "relations", "graph_id", "vocabulary")
    out = extract.valid_relations(raw, kinds(spark, folder), ON, concepts(spark, folder), G)
    return out.select("graph_id", "pos", "source", "relation", "target")


def json_triples(spark: SparkSession, folder: str) -> DataFrame:
    """The same triples through the JSON of a model response."""
    text = F.to_json(F.struct(F.col("entities").alias("concepts"), "relations"))
    said = staging(spark, folder, "entities", "relations").select("graph_id", F.try_parse_json(text).alias("v"))
    parts = said.select("graph_id", F.try_variant_get("v", "$.relations", "variant").alias("raw"))
    return extract.triples(parts, "raw", "graph_id")


def json_concepts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("entities").alias("concepts")))
    said = staging(spark, folder, "entities", once=False).select("graph_id", F.try_parse_json(text).alias("v"))
    parts = said.select("graph_id", F.try_variant_get("v", "$.concepts", "variant").alias("raw"))
    return extract.concepts(parts, "raw", "graph_id").distinct()


def global_link_union(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of chunks, and of the global pass where both ends were found in chunks."""
    vocabulary = staging(spark, folder, "vocabulary")
    rows = table(spark, folder, "triples").select("graph_id", "doc_id", "source", "relation", "target").join(vocabulary, "graph_id")
    local = extract.valid_relations(rows.filter("doc_id is not null"), kinds(spark, folder), ON)
    inventory = extract.universe(local.select("graph_id", F.col("source").alias("name")), local, G)
    linked = extract.valid_relations(rows.filter("doc_id is null"), kinds(spark, folder), ON, inventory, G)
    return extract.distinct_triples(local.unionByName(linked), G)


def evidence_topk(spark: SparkSession, folder: str) -> DataFrame:
    return clean.evidence(relations(spark, folder), G, 6, merged(spark, folder))


def node_lines(spark: SparkSession, folder: str) -> DataFrame:
    own = merged(spark, folder)
    proof = clean.evidence(relations(spark, folder), G, 6, own)
    return clean.node_lines(own.select("graph_id", F.col("representative").alias("name")).distinct(), proof, G)


def alias_map(spark: SparkSession, folder: str) -> DataFrame:
    """The alias map of every response."""
    said = table(spark, folder, "clean").dropDuplicates(["response_id"])
    valid = merged(spark, folder).select("graph_id", F.col("representative").alias("name")).distinct()
    keys = ["graph_id", "response_id"]
    listed = proposal(said, *keys)
    each = said.select(*keys).join(valid, "graph_id")
    return clean.alias_map(listed, each, keys).select("response_id", "name", "target")


def cleaned_triples(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.distinct_triples(relations(spark, folder, once=False), G)
    return clean.apply_node_map(found, checkpointed(nodes(spark, folder)), G)


def domains(spark: SparkSession, folder: str) -> DataFrame:
    raw = curated(spark, folder, "concepts_by_domains").select("graph_id", F.posexplode(F.map_entries("concepts_by_domains")).alias("ord", "e"))
    listed = raw.select("graph_id", "ord", F.col("e.key").alias("domain"), F.explode("e.value").alias("name"))
    return curate.reconcile_domains(concepts(spark, folder), listed, G, F.lit("Unclassified")).select("graph_id", "domain", "name", "leftover")


def non_taggable(spark: SparkSession, folder: str) -> DataFrame:
    raw = curated(spark, folder, "generic_non_taggable_concepts").select("graph_id", F.explode("generic_non_taggable_concepts").alias("name"))
    return curate.non_taggable(raw, concepts(spark, folder), G)


def typed_relations(spark: SparkSession, folder: str) -> DataFrame:
    return curate.adjacency(typed(spark, folder), G).select("graph_id", "relation", "source", F.array_join("targets", "\n").alias("targets"))


def acyclic_relations(spark: SparkSession, folder: str) -> DataFrame:
    out = graph.break_cycles(typed(spark, folder), kinds(spark, folder), ON, G)
    return out.select("graph_id", "relation", "source", "target")


def removed_relations(spark: SparkSession, folder: str) -> DataFrame:
    strict = typed(spark, folder).join(kinds(spark, folder).filter("directed and acyclic"), ON, "left_semi")
    return graph.back_edges(strict, ["graph_id", "relation"])


def removed_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each graph and acyclic kind: its relations, kept and removed; nodes still on a cycle; relations removed that closed none."""
    kinds_ = kinds(spark, folder)
    strict = checkpointed(typed(spark, folder).join(kinds_.filter("directed and acyclic"), ON, "left_semi"))
    keys = ["graph_id", "relation"]
    kept = checkpointed(graph.break_cycles(strict, kinds_, ON, G).select(*keys, "source", "target"))
    removed = checkpointed(removed_relations(spark, folder))
    left = hierarchy(kept, keys, "target", "source", "cycles").select(*keys)
    below = hierarchy(kept, keys, "target", "source", "descendants").select(*keys, F.col("node").alias("target"), F.col("descendant").alias("source"))
    idle = removed.filter("source <> target").join(below, [*keys, "source", "target"], "left_anti").select(*keys)
    tagged = lambda df, n: df.select(*keys, *[F.lit(int(k == n)).alias(k) for k in ("links", "cycles_left", "idle")])
    rows = [tagged(kept, "links"), tagged(removed, "links"), tagged(left, "cycles_left"), tagged(idle, "idle")]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("links", "cycles_left", "idle")])


def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(relations(spark, folder, once=False), listed(spark, folder), G)  # the ends are names anyway


def communities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.communities(relations(spark, folder, once=False), listed(spark, folder), G)


def communities_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Of each graph: its names; linked pairs of communities that would be better as one; whether modularity is below that of single names."""
    own = checkpointed(communities(spark, folder))
    simple = relations(spark, folder, once=False).select("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    of = lambda c: own.select("graph_id", F.col("name").alias(c), F.col("community").alias(f"c{c}"))
    links = checkpointed(simple.join(of("a"), ["graph_id", "a"]).join(of("b"), ["graph_id", "b"]))
    total = links.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m"))
    degree = links.select("graph_id", F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("ca").alias("c")), F.struct(F.col("b").alias("name"), F.col("cb").alias("c")))).alias("e")).groupBy("graph_id", "e.c", "e.name").agg(F.count(F.lit(1)).alias("d"))
    load = checkpointed(degree.groupBy("graph_id", "c").agg(F.sum("d").alias("d"), F.sum(F.col("d") * F.col("d")).alias("d2")))
    side = lambda c: load.select("graph_id", F.col("c").alias(c), F.col("d").alias(f"d{c}"))
    between = links.filter("ca <> cb").groupBy("graph_id", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.count(F.lit(1)).alias("w"))
    better = between.join(side("x"), ["graph_id", "x"]).join(side("y"), ["graph_id", "y"]).join(total, "graph_id").filter("w - dx * dy / (2 * m) > 1e-9")
    inner = links.filter("ca = cb").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    sums = load.groupBy("graph_id").agg(F.sum(F.col("d") * F.col("d")).alias("all"), F.sum("d2").alias("alone"))
    worse = sums.join(total, "graph_id").join(inner, "graph_id", "left").filter("coalesce(n, 0) / m - (all - alone) / (4 * m * m) < -1e-9")
    kinds_ = ("names", "better", "worse")
    tagged = lambda df, n: df.select("graph_id", *[F.lit(int(k == n)).alias(k) for k in kinds_])
    rows = [tagged(own, "names"), tagged(better, "better"), tagged(worse, "worse")]
    return reduce(DataFrame.unionByName, rows).groupBy("graph_id").agg(*[F.sum(k).alias(k) for k in kinds_])


def cluster_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hubs(components(spark, folder), relations(spark, folder, once=False), G, "component")


def community_hubs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hubs(communities(spark, folder), relations(spark, folder, once=False), G, "community")


def curated_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _curated_parts(spark, folder)["edges"].select("graph_id", "rel", "source", "target")


def _curated_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    graphs = curated(spark, folder, "concepts_by_domains", "generic_non_taggable_concepts", "relations")
    return view.curated_parts(graphs, G, table(spark, folder, "relation_types").withColumnRenamed("rel_key", "key"))


def _flat_parts(spark: SparkSession, folder: str, grouped=None, group: str = "") -> dict[str, DataFrame]:  # noqa: ANN001
    raw = staging(spark, folder, "vocabulary", "entities", "edges", "relations", once=False)
    types = table(spark, folder, "relation_types").withColumnRenamed("rel_key", "key")
    triples = extract.array_triples(raw, "relations", "graph_id")
    every = checkpointed(extract.universe(raw.select("graph_id", F.explode("entities").alias("name")).filter("name is not null"), triples, G))
    group_of = None
    if grouped:
        groups = checkpointed(grouped(triples, every, G))
        labels = graph.hubs(groups, triples, G, group)
        group_of = groups.join(labels, ["graph_id", group]).select("graph_id", "name", F.col("label").alias("group"))
    return view.flat_parts(raw, G, ["vocabulary"], types, every, group_of)


def _component_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return _flat_parts(spark, folder, graph.components, "component")


def _community_parts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Flat graphs grouped as the pipeline's viewer groups them."""
    return _flat_parts(spark, folder, graph.communities, "community")


def _view(parts, which: str):  # noqa: ANN001, ANN202
    return lambda spark, folder: view.ViewModel(parts(spark, folder), G)[which].drop("pos")


def flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The interchange form of the staging graphs after validation."""
    out = extract.flat_graph(names(spark, folder), relations(spark, folder, once=False), G)
    lines = F.transform("relations", lambda r: F.array_join(r, "\t"))
    return out.select("graph_id", F.array_join("entities", "\n").alias("entities"), F.array_join("edges", ",").alias("edges"), F.array_join(lines, "\n").alias("relations"))


def stage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What each graph has before and after cleaning."""
    own = checkpointed(nodes(spark, folder))
    found = checkpointed(extract.distinct_triples(relations(spark, folder, once=False), G))
    moved = clean.apply_node_map(found, own, G)
    kinds = ("nodes", "triples", "cleaned_nodes", "cleaned_triples")
    tagged = lambda df, n: df.select("graph_id", *[F.lit(int(k == n)).alias(k) for k in kinds])
    rows = [tagged(own, "nodes"), tagged(found, "triples"), tagged(clean.entities(own, G, blank=True), "cleaned_nodes"), tagged(moved, "cleaned_triples")]
    counts = reduce(DataFrame.unionByName, rows).groupBy("graph_id").agg(*[F.sum(k).alias(k) for k in kinds])
    return counts.filter("nodes > 0")


def queries() -> dict:
    return {
        "chunk_text": chunk_text,
        "concept_filter": concepts,
        "json_concepts": json_concepts,
        "json_triples": json_triples,
        "valid_relations": lambda s, d: relations(s, d).select("graph_id", "pos", "source", "relation", "target"),
        "valid_relations_inventory": relations_in_inventory,
        "distinct_triples": lambda s, d: extract.distinct_triples(relations(s, d, once=False), G),
        "edge_types": lambda s, d: relations(s, d, once=False).select("graph_id", "relation").distinct(),
        "endpoint_closure": names,
        "global_link_union": global_link_union,
        "flat_graph": flat_graph,
        "name_keys": name_keys,
        "deterministic_merge": merged,
        "evidence_topk": evidence_topk,
        "node_lines": node_lines,
        "alias_map": alias_map,
        "node_map": nodes,
        "cleaned_triples": cleaned_triples,
        "cleaned_entities": lambda s, d: clean.entities(nodes(s, d), G),
        "domains": domains,
        "non_taggable": non_taggable,
        "typed_relations": typed_relations,
        "acyclic_relations": acyclic_relations,
        "removed_relations": removed_relations,
        "removed_checked": removed_checked,
        "communities_checked": communities_checked,
        "components": components,
        "communities": communities,
        "cluster_hubs": cluster_hubs,
        "community_hubs": community_hubs,
        "curated_edges": curated_edges,
        "view_groups": _view(_curated_parts, "groups"),
        "view_nodes": _view(_curated_parts, "nodes"),
        "view_links": _view(_curated_parts, "links"),
        "view_relations": _view(_curated_parts, "relations"),
        "view_isolated": _view(_curated_parts, "isolated"),
        "flat_view_groups": _view(_component_parts, "groups"),
        "flat_view_nodes": _view(_component_parts, "nodes"),
        "flat_view_links": _view(_flat_parts, "links"),
        "flat_view_relations": _view(_flat_parts, "relations"),
        "flat_view_community_groups": _view(_community_parts, "groups"),
        "flat_view_community_nodes": _view(_community_parts, "nodes"),
        "stage_counts": stage_counts,
    }


# --- SQL --------------------------------------------------------------------------------------------------------------

_W = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"


def _key(x: str, qualifier: str = "") -> str:
    s = _strip(f"lower({x})")
    if qualifier:
        s = f"regexp_replace({s}, '{qualifier}', '', 'g')"
    s = _strip(f"regexp_replace(strip_accents({s}), '{_W}+', ' ', 'g')")
    return f"(CASE WHEN length({s}) > 3 AND suffix({s}, 's') THEN left({s}, length({s}) - 1) ELSE {s} END)"


_STAGING = f"""
g AS (SELECT DISTINCT ON (graph_id) graph_id, vocabulary, entities, edges, relations FROM knowledge_graph_partial),
concepts AS (SELECT DISTINCT graph_id, {_strip("e")} AS name FROM (SELECT graph_id, unnest(entities) AS e FROM g) WHERE e IS NOT NULL AND {_strip("e")} <> ''),
raw AS (SELECT graph_id, vocabulary, unnest(relations) AS r, generate_subscripts(relations, 1) - 1 AS pos FROM g),
three AS (SELECT graph_id, vocabulary, pos::INTEGER AS pos, r[1] AS source, r[2] AS relation, r[3] AS target FROM raw
  WHERE len(r) = 3 AND r[1] IS NOT NULL AND r[2] IS NOT NULL AND r[3] IS NOT NULL),
rel AS (SELECT t.* FROM (SELECT graph_id, vocabulary, pos, {_strip("source")} AS source, {_strip("relation")} AS relation, {_strip("target")} AS target FROM three) t
  JOIN relation_types k ON k.vocabulary = t.vocabulary AND k.rel_key = t.relation WHERE source <> '' AND target <> '' AND source <> target),
names AS (SELECT graph_id, name FROM concepts UNION SELECT graph_id, source FROM rel UNION SELECT graph_id, target FROM rel)
"""
_MERGED = f"""{_STAGING},
keyed AS (SELECT graph_id, name, {_key("name")} AS key FROM names),
merged AS (SELECT graph_id, name, first_value(name) OVER (PARTITION BY graph_id, key ORDER BY regexp_matches(name, '^\\p{{Ll}}'), length(name), name) AS representative FROM keyed)
"""
_NODES = f"""{_MERGED},
said AS (SELECT DISTINCT ON (graph_id) graph_id, response_id, canonical, dropped FROM clean WHERE canonical IS NOT NULL ORDER BY graph_id, batch_no DESC, attempt DESC, response_id DESC),
resp AS (SELECT graph_id, response_id, canonical FROM said),
ALIAS,
drops AS (SELECT DISTINCT graph_id, name FROM (SELECT graph_id, unnest(dropped) AS name FROM said) WHERE name IS NOT NULL),
nodes AS (SELECT m.graph_id, m.name, CASE WHEN d.name IS NULL THEN coalesce(a.target, m.representative) END AS canonical FROM merged m
  LEFT JOIN aliases a ON a.graph_id = m.graph_id AND a.name = m.representative LEFT JOIN drops d ON d.graph_id = m.graph_id AND d.name = m.representative)
"""
_ALIAS = """
entries AS (SELECT graph_id, response_id, unnest(map_entries(canonical)) AS e, generate_subscripts(map_entries(canonical), 1) AS ord FROM resp),
listed AS (SELECT graph_id, response_id, ord, list_concat([e.key], coalesce(e.value, [])) AS xs FROM entries),
members AS (SELECT l.graph_id, l.response_id, ord, pos, name FROM (SELECT graph_id, response_id, ord, unnest(xs) AS name, generate_subscripts(xs, 1) AS pos FROM listed) l
  WHERE EXISTS (SELECT 1 FROM merged m WHERE m.graph_id = l.graph_id AND m.representative = l.name)),
firsts AS (SELECT response_id, ord, arg_min(name, pos) AS target FROM members GROUP BY ALL),
aliases AS (SELECT m.graph_id, m.response_id, m.name, arg_max(f.target, m.ord * 1000000 + m.pos) AS target FROM members m JOIN firsts f ON f.response_id = m.response_id AND f.ord = m.ord GROUP BY ALL)
"""
_NODES = _NODES.replace("ALIAS", _ALIAS.strip())
_TYPED = f"""{_STAGING},
typed AS (SELECT DISTINCT t.graph_id, t.vocabulary, coalesce(k.rel_key, f.rel_key) AS relation, t.source, t.target FROM three t
  LEFT JOIN relation_types k ON k.vocabulary = t.vocabulary AND k.rel_key = t.relation LEFT JOIN relation_types f ON f.vocabulary = t.vocabulary AND f.fallback
  WHERE EXISTS (SELECT 1 FROM names n WHERE n.graph_id = t.graph_id AND n.name = t.source) AND EXISTS (SELECT 1 FROM names n WHERE n.graph_id = t.graph_id AND n.name = t.target))
"""


def _components(links: str, names: str) -> str:
    return f"""ways AS (SELECT graph_id, source AS a, target AS b FROM {links} UNION SELECT graph_id, target, source FROM {links}),
reach AS (SELECT graph_id, name AS a, name AS b FROM {names} UNION SELECT r.graph_id, r.a, l.b FROM reach r JOIN ways l ON l.graph_id = r.graph_id AND l.a = r.b),
components AS (SELECT graph_id, a AS name, min(b) AS component FROM reach GROUP BY ALL)"""


def _hubs(links: str) -> str:
    return f"""simple AS (SELECT DISTINCT graph_id, least(source, target) AS a, greatest(source, target) AS b FROM {links}),
degree AS (SELECT graph_id, name, count(*) AS n FROM (SELECT graph_id, a AS name FROM simple UNION ALL SELECT graph_id, b FROM simple) GROUP BY ALL),
hubs AS (SELECT DISTINCT ON (c.graph_id, component) c.graph_id, component, 'Cluster · ' || c.name AS label FROM components c LEFT JOIN degree d ON d.graph_id = c.graph_id AND d.name = c.name
  ORDER BY c.graph_id, component, coalesce(n, 0) DESC, length(c.name), c.name DESC)"""


_EVIDENCE = """, moved AS (SELECT r.graph_id, r.pos, s.representative AS name, r.relation || ' ' || t.representative AS text FROM rel r
  JOIN merged s ON s.graph_id = r.graph_id AND s.name = r.source JOIN merged t ON t.graph_id = r.graph_id AND t.name = r.target),
proof AS (SELECT * FROM (SELECT graph_id, name, row_number() OVER (PARTITION BY graph_id, name ORDER BY pos) AS nth, text FROM moved) WHERE nth <= 6)"""

_CURATED = r"""
WITH c AS (SELECT DISTINCT ON (graph_id) * FROM knowledge_graph_autogenerated),
de AS (SELECT graph_id, unnest(map_entries(concepts_by_domains)) AS e, generate_subscripts(map_entries(concepts_by_domains), 1) AS d FROM c),
listed AS (SELECT graph_id, d, e.key AS "group", unnest(e.value) AS name FROM de),
group_of AS (SELECT graph_id, name, arg_min("group", d) AS "group" FROM listed WHERE name IS NOT NULL GROUP BY ALL),
gr AS (SELECT graph_id, unnest(relations) AS g, generate_subscripts(relations, 1) - 1 AS rel FROM c),
rels AS (SELECT graph_id, rel::INTEGER AS rel, g, coalesce(t.rel_key, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(coalesce(g.details.verbose, ''))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'relation')) AS key,
  coalesce(g.details.verbose, t.verbose) AS verbose, coalesce(g.details.directed, t.directed, true) AS directed, coalesce(g.details.acyclic, t.acyclic, false) AS acyclic,
  coalesce(g.details.use_in_embedding, t.use_in_embedding, true) AS use_in_embedding
  FROM gr LEFT JOIN relation_types t ON t.verbose = g.details.verbose),
se AS (SELECT graph_id, rel, unnest(map_entries(g.relations_data)) AS e, generate_subscripts(map_entries(g.relations_data), 1) AS s FROM rels),
te AS (SELECT graph_id, rel, s, e.key AS source, unnest(e.value) AS target, generate_subscripts(e.value, 1) AS t FROM se),
edges AS (SELECT graph_id, rel, [rel, s, t] AS pos, source, target FROM te WHERE target IS NOT NULL),
flagged AS (SELECT DISTINCT graph_id, name FROM (SELECT graph_id, unnest(generic_non_taggable_concepts) AS name FROM c) WHERE name IS NOT NULL)"""
_FLAT = f"""
WITH RECURSIVE {_STAGING},
every AS (SELECT DISTINCT graph_id, name FROM (SELECT graph_id, unnest(entities) AS name FROM g UNION SELECT graph_id, source FROM three UNION SELECT graph_id, target FROM three) WHERE name IS NOT NULL),
{_components("three", "every")},
{_hubs("three")},
group_of AS (SELECT c.graph_id, c.name, h.label AS "group" FROM components c JOIN hubs h ON h.graph_id = c.graph_id AND h.component = c.component),
ak AS (SELECT graph_id, vocabulary, 0 AS tier, pos, key FROM (SELECT graph_id, vocabulary, unnest(edges) AS key, generate_subscripts(edges, 1) - 1 AS pos FROM g) WHERE key IS NOT NULL
  UNION ALL SELECT graph_id, vocabulary, 1, pos, relation FROM three),
ko AS (SELECT graph_id, vocabulary, key, min(tier * 1000000000 + pos) AS o FROM ak GROUP BY ALL),
rels AS (SELECT k.graph_id, (row_number() OVER (PARTITION BY k.graph_id ORDER BY o) - 1)::INTEGER AS rel, k.key, coalesce(t.verbose, replace(k.key, '_', ' ')) AS verbose,
  coalesce(t.directed, true) AS directed, coalesce(t.acyclic, false) AS acyclic, coalesce(t.use_in_embedding, true) AS use_in_embedding
  FROM ko k LEFT JOIN relation_types t ON t.vocabulary = k.vocabulary AND t.rel_key = k.key),
edges AS (SELECT t.graph_id, r.rel, t.pos, t.source, t.target FROM three t JOIN rels r ON r.graph_id = t.graph_id AND r.key = t.relation),
flagged AS (SELECT graph_id, name FROM group_of WHERE false)"""
_VIEW = """,
vn AS (SELECT graph_id, name FROM group_of UNION SELECT graph_id, source FROM edges UNION SELECT graph_id, target FROM edges),
named AS (SELECT n.graph_id, n.name, coalesce(g."group", '—') AS "group" FROM vn n LEFT JOIN group_of g ON g.graph_id = n.graph_id AND g.name = n.name),
groups AS (SELECT graph_id, "group", count(*) AS count, (row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, "group") - 1)::INTEGER AS idx FROM named GROUP BY graph_id, "group"),
vnodes AS (SELECT n.graph_id, (row_number() OVER (PARTITION BY n.graph_id ORDER BY n.name) - 1)::INTEGER AS idx, n.name, g.idx AS group_idx, (f.name IS NOT NULL)::INTEGER AS flag
  FROM named n JOIN groups g ON g.graph_id = n.graph_id AND g."group" = n."group" LEFT JOIN flagged f ON f.graph_id = n.graph_id AND f.name = n.name),
number AS (SELECT graph_id, key, max(rel) AS r FROM rels GROUP BY ALL),
real AS (SELECT e.graph_id, n.r, e.pos, e.source, e.target, s.directed FROM edges e JOIN rels x ON x.graph_id = e.graph_id AND x.rel = e.rel
  JOIN number n ON n.graph_id = e.graph_id AND n.key = x.key JOIN rels s ON s.graph_id = e.graph_id AND s.rel = n.r WHERE e.source <> e.target),
vlinks AS (SELECT DISTINCT ON (graph_id, r, a, b) graph_id, r, source, target FROM (SELECT *, CASE WHEN directed THEN source ELSE least(source, target) END AS a, CASE WHEN directed THEN target ELSE greatest(source, target) END AS b FROM real)
  ORDER BY graph_id, r, a, b, pos)
"""
_VIEWS = {
    "groups": 'SELECT graph_id, idx, "group", count FROM groups',
    "nodes": "SELECT graph_id, idx, name, group_idx, flag FROM vnodes",
    "links": "SELECT l.graph_id, s.idx AS s, t.idx AS t, l.r FROM vlinks l JOIN vnodes s ON s.graph_id = l.graph_id AND s.name = l.source JOIN vnodes t ON t.graph_id = l.graph_id AND t.name = l.target",
    "relations": "SELECT r.graph_id, r.rel AS idx, r.key, r.verbose, r.directed, r.acyclic, r.use_in_embedding, (SELECT count(*) FROM vlinks l JOIN rels x ON x.graph_id = l.graph_id AND x.rel = l.r WHERE l.graph_id = r.graph_id AND x.key = r.key) AS count FROM rels r",
    "isolated": "SELECT graph_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM vlinks l WHERE l.graph_id = n.graph_id AND (l.source = n.name OR l.target = n.name))) AS isolated FROM vnodes n GROUP BY graph_id",
}


def oracle_sql() -> dict[str, str]:
    s, m, n, t = (f"WITH RECURSIVE {x} " for x in (_STAGING, _MERGED, _NODES, _TYPED))
    chunk = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{_W}*\\n'), lambda x: {_strip("x")}), lambda x: x <> '') AS ps FROM t),
c AS (SELECT config_id, doc_id, chunk_size, ps FROM p JOIN builder_config ON len(ps) > 0),
f AS (SELECT config_id, doc_id, chunk_size, ps, 1 AS i, 0 AS chunk_no, ps[1] AS cur FROM c
  UNION ALL SELECT config_id, doc_id, chunk_size, ps, i + 1, chunk_no + (length(cur) + length(ps[i + 1]) + 2 > chunk_size)::INTEGER,
    CASE WHEN length(cur) + length(ps[i + 1]) + 2 > chunk_size THEN ps[i + 1] ELSE cur || chr(10) || chr(10) || ps[i + 1] END FROM f WHERE i < len(ps))
SELECT config_id, doc_id, chunk_no, arg_max(cur, i) AS chunk FROM f GROUP BY config_id, doc_id, chunk_no"""
    keys = f"SELECT graph_id, name, {_key('name')} AS key, {_key('name', QUALIFIER)} AS qualified, coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'relation') AS slug FROM names"
    concept = "SELECT graph_id, name FROM concepts"
    every = f"WITH RECURSIVE {_MERGED}, resp AS (SELECT DISTINCT ON (response_id) graph_id, response_id, canonical FROM clean), {_ALIAS} "
    moved = "SELECT DISTINCT r.graph_id, s.canonical AS source, r.relation, t.canonical AS target FROM rel r JOIN nodes s ON s.graph_id = r.graph_id AND s.name = r.source JOIN nodes t ON t.graph_id = r.graph_id AND t.name = r.target WHERE s.canonical <> '' AND t.canonical <> ''"
    components = s.rstrip() + ", " + _components("rel", "names")
    out = {
        "chunk_text": chunk,
        "concept_filter": s + concept,
        "json_concepts": s + concept,
        "json_triples": s + "SELECT graph_id, pos, source, relation, target FROM three",
        "valid_relations": s + "SELECT graph_id, pos, source, relation, target FROM rel",
        "valid_relations_inventory": s + "SELECT graph_id, pos, source, relation, target FROM rel SEMI JOIN concepts a ON a.graph_id = rel.graph_id AND a.name = rel.source SEMI JOIN concepts b ON b.graph_id = rel.graph_id AND b.name = rel.target",
        "distinct_triples": s + "SELECT DISTINCT graph_id, source, relation, target FROM rel",
        "edge_types": s + "SELECT DISTINCT graph_id, relation FROM rel",
        "endpoint_closure": s + "SELECT graph_id, name FROM names",
        "global_link_union": f"""
WITH v AS (SELECT DISTINCT graph_id, vocabulary FROM knowledge_graph_partial),
t AS (SELECT graph_id, doc_id, {_strip("source")} AS source, {_strip("relation")} AS relation, {_strip("target")} AS target FROM triples),
ok AS (SELECT t.* FROM t JOIN v ON v.graph_id = t.graph_id JOIN relation_types k ON k.vocabulary = v.vocabulary AND k.rel_key = t.relation WHERE source <> '' AND target <> '' AND source <> target),
inv AS (SELECT graph_id, source AS name FROM ok WHERE doc_id IS NOT NULL UNION SELECT graph_id, target FROM ok WHERE doc_id IS NOT NULL)
SELECT DISTINCT graph_id, source, relation, target FROM ok WHERE doc_id IS NOT NULL OR (
  EXISTS (SELECT 1 FROM inv WHERE inv.graph_id = ok.graph_id AND inv.name = ok.source) AND EXISTS (SELECT 1 FROM inv WHERE inv.graph_id = ok.graph_id AND inv.name = ok.target))""",
        "flat_graph": s.rstrip() + """, e AS (SELECT graph_id, string_agg(name, chr(10) ORDER BY name) AS entities FROM names GROUP BY ALL),
d AS (SELECT DISTINCT graph_id, source, relation, target FROM rel),
r AS (SELECT graph_id, string_agg(source || chr(9) || relation || chr(9) || target, chr(10) ORDER BY source, relation, target) AS relations FROM d GROUP BY ALL),
k AS (SELECT graph_id, string_agg(relation, ',' ORDER BY relation) AS edges FROM (SELECT DISTINCT graph_id, relation FROM rel) GROUP BY ALL)
SELECT e.graph_id, e.entities, coalesce(k.edges, '') AS edges, coalesce(r.relations, '') AS relations FROM e LEFT JOIN r ON r.graph_id = e.graph_id LEFT JOIN k ON k.graph_id = e.graph_id""",
        "name_keys": s + keys,
        "deterministic_merge": m + "SELECT graph_id, name, representative FROM merged",
        "evidence_topk": m.rstrip() + _EVIDENCE + " SELECT graph_id, name, nth, text FROM proof",
        "node_lines": m.rstrip() + _EVIDENCE + """, w AS (SELECT graph_id, name, string_agg(text, '; ' ORDER BY nth) AS why FROM proof GROUP BY ALL)
SELECT DISTINCT m.graph_id, m.representative AS name, '- ' || m.representative || coalesce('  [' || why || ']', '') AS line FROM merged m LEFT JOIN w ON w.graph_id = m.graph_id AND w.name = m.representative""",
        "alias_map": every + "SELECT response_id, name, target FROM aliases",
        "node_map": n + "SELECT graph_id, name, canonical FROM nodes",
        "cleaned_triples": n + moved,
        "cleaned_entities": n + "SELECT DISTINCT graph_id, canonical AS name FROM nodes WHERE canonical <> ''",
        "domains": s.rstrip() + """, c AS (SELECT DISTINCT ON (graph_id) graph_id, concepts_by_domains AS m FROM knowledge_graph_autogenerated),
de AS (SELECT graph_id, unnest(map_entries(m)) AS e, generate_subscripts(map_entries(m), 1) AS ord FROM c),
l AS (SELECT graph_id, ord, e.key AS domain, unnest(e.value) AS name FROM de),
p AS (SELECT l.graph_id, l.name, arg_min(domain, ord) AS domain FROM l JOIN concepts n ON n.graph_id = l.graph_id AND n.name = l.name GROUP BY ALL)
SELECT n.graph_id, coalesce(p.domain, 'Unclassified') AS domain, n.name, p.domain IS NULL AS leftover FROM concepts n LEFT JOIN p ON p.graph_id = n.graph_id AND p.name = n.name""",
        "non_taggable": s.rstrip() + """, c AS (SELECT DISTINCT graph_id, unnest(generic_non_taggable_concepts) AS name FROM knowledge_graph_autogenerated)
SELECT c.graph_id, c.name FROM c JOIN concepts n ON n.graph_id = c.graph_id AND n.name = c.name""",
        "typed_relations": t + "SELECT graph_id, relation, source, string_agg(target, chr(10) ORDER BY target) AS targets FROM typed WHERE relation IS NOT NULL GROUP BY graph_id, relation, source",
        # What holds of any right result: which of several links closes a cycle, or which communities are found, no SQL can say.
        "removed_checked": t + "SELECT graph_id, typed.relation, count(*) AS links, 0 AS cycles_left, 0 AS idle FROM typed JOIN relation_types k ON k.vocabulary = typed.vocabulary AND k.rel_key = typed.relation WHERE k.directed AND k.acyclic GROUP BY graph_id, typed.relation",
        "communities_checked": s + "SELECT graph_id, count(*) AS names, 0 AS better, 0 AS worse FROM names GROUP BY graph_id",
        "components": components + " SELECT graph_id, name, component FROM components",
        "cluster_hubs": components + ", " + _hubs("rel") + " SELECT graph_id, component, label FROM hubs",
        "curated_edges": _CURATED + " SELECT graph_id, rel, source, target FROM edges",
        "stage_counts": n.rstrip() + f""", moved AS ({moved}),
d AS (SELECT DISTINCT graph_id, source, relation, target FROM rel)
SELECT x.graph_id, count(*) AS nodes, (SELECT count(*) FROM d WHERE d.graph_id = x.graph_id) AS triples, count(DISTINCT x.canonical) AS cleaned_nodes, (SELECT count(*) FROM moved y WHERE y.graph_id = x.graph_id) AS cleaned_triples
FROM nodes x GROUP BY x.graph_id""",
    }
    out |= {f"view_{k}": _CURATED + _VIEW + q for k, q in _VIEWS.items()}
    out |= {f"flat_view_{k}": _FLAT + _VIEW + q for k, q in _VIEWS.items() if k != "isolated"}
    return out
