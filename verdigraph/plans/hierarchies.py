"""Hierarchies of the graph tables (problem 1): queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.operators.hierarchy import hierarchy
from verdigraph.runtime import table

SCOPE = ["origin", "graph_id", "relation"]
#: A string that is more than white space (as str.isspace has it).
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def well_formed(graphs: DataFrame, *keep: str) -> DataFrame:
    """Elements of ``relations`` of exactly three strings, none null or blank, as source, relation, target."""
    r = F.col("r")
    ends = F.col("source").rlike(NOT_BLANK) & F.col("relation").rlike(NOT_BLANK) & F.col("target").rlike(NOT_BLANK)
    parts = [F.get(r, F.lit(i)).alias(n) for i, n in enumerate(("source", "relation", "target"))]
    return graphs.select(*keep, F.explode("relations").alias("r")).filter(F.size("r") == 3).select(*keep, *parts).filter(ends)


def directed_links(spark: SparkSession, folder: str) -> DataFrame:
    """A source is below its targets: origin, graph_id, relation, child, parent."""
    kinds = table(spark, folder, "relation_types").filter("directed").select("vocabulary", F.col("rel_key").alias("relation"))
    raw = well_formed(table(spark, folder, "knowledge_graph_partial"), "graph_id", "vocabulary")
    partial = raw.join(kinds, ["vocabulary", "relation"], "left_semi")
    groups = table(spark, folder, "knowledge_graph_autogenerated").select("graph_id", F.explode("relations").alias("g")).filter("g.details.directed")
    curated = groups.select("graph_id", F.col("g.details.verbose").alias("relation"), F.explode("g.relations_data").alias("source", "targets"))
    curated = curated.select("graph_id", "relation", "source", F.explode("targets").alias("target"))
    ends = ["graph_id", "relation", F.col("source").alias("child"), F.col("target").alias("parent")]
    return partial.select(F.lit("partial").alias("origin"), *ends).unionByName(curated.select(F.lit("autogenerated").alias("origin"), *ends))


def _query(emit: str):  # noqa: ANN202
    return lambda spark, folder: hierarchy(directed_links(spark, folder), SCOPE, "child", "parent", emit)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes on a cycle, off their rows in the hierarchy."""
    return hierarchy(directed_links(spark, folder), SCOPE, "child", "parent", "nodes", only_cycles=True).select(*SCOPE, "node")


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_nodes": _query("nodes"),
        "p1_paths": _query("paths"),
        "p1_descendants": _query("descendants"),
    }


_REACH = """
WITH RECURSIVE t AS (
  SELECT graph_id, vocabulary, unnest(relations) AS r FROM knowledge_graph_partial
), links AS (
  SELECT DISTINCT 'partial' AS origin, graph_id, r[2] AS relation, r[1] AS child, r[3] AS parent
  FROM t JOIN relation_types k ON k.vocabulary = t.vocabulary AND k.rel_key = r[2]
  WHERE len(r) = 3 AND k.directed AND regexp_matches(r[1], '[^\\s\\pZ]') AND regexp_matches(r[3], '[^\\s\\pZ]')
  UNION
  SELECT 'autogenerated', graph_id, relation, e.key, unnest(e.value)
  FROM (SELECT graph_id, g.details.verbose AS relation, unnest(map_entries(g.relations_data)) AS e
        FROM (SELECT graph_id, unnest(relations) AS g FROM knowledge_graph_autogenerated) WHERE g.details.directed)
), clean AS (
  SELECT * FROM links WHERE child IS NOT NULL AND parent IS NOT NULL
), reach AS (
  SELECT * FROM clean
  UNION
  SELECT reach.origin, reach.graph_id, reach.relation, reach.child, l.parent
  FROM reach JOIN clean l ON l.origin = reach.origin AND l.graph_id = reach.graph_id AND l.relation = reach.relation AND l.child = reach.parent
)
"""


# Cycles as single steps, all ways down to each step, then the heavy paths of the deepest parents' forest.
_STEPS = (
    _REACH.rstrip()
    + """, nodes AS (
  SELECT DISTINCT dense_rank() OVER (ORDER BY origin, graph_id, relation) AS g, * FROM (
    SELECT origin, graph_id, relation, child AS node FROM clean UNION SELECT origin, graph_id, relation, parent FROM clean)
), num AS (
  SELECT DISTINCT g, origin, graph_id, relation FROM nodes
), rg AS (
  SELECT g, child, parent FROM reach r JOIN num n ON n.origin = r.origin AND n.graph_id = r.graph_id AND n.relation = r.relation
), cyc AS (
  SELECT a.g, a.child AS node, min(a.parent) AS cycle FROM rg a JOIN rg b ON b.g = a.g AND b.child = a.parent AND b.parent = a.child GROUP BY a.g, a.child
), st AS (
  SELECT n.g, n.node, c.cycle, coalesce(c.cycle, n.node) AS step FROM nodes n LEFT JOIN cyc c ON c.g = n.g AND c.node = n.node
), dag AS (
  SELECT DISTINCT n.g, a.step AS c, b.step AS p FROM clean l JOIN num n ON n.origin = l.origin AND n.graph_id = l.graph_id AND n.relation = l.relation
  JOIN st a ON a.g = n.g AND a.node = l.child JOIN st b ON b.g = n.g AND b.node = l.parent WHERE a.step <> b.step
), ways AS (
  SELECT DISTINCT g, step, [step] AS path FROM st WHERE NOT EXISTS (SELECT 1 FROM dag d WHERE d.g = st.g AND d.c = st.step)
  UNION ALL SELECT d.g, d.c, list_append(w.path, d.c) FROM ways w JOIN dag d ON d.g = w.g AND d.p = w.step
)
"""
)
_HEAVY = """, depths AS (
  SELECT g, step, max(len(path)) - 1 AS depth, list_sort(list_distinct(list(path[1]))) AS roots FROM ways GROUP BY g, step
), up AS (
  SELECT d.g, d.c AS step, min(d.p) AS above FROM dag d JOIN depths a ON a.g = d.g AND a.step = d.c JOIN depths b ON b.g = d.g AND b.step = d.p AND b.depth = a.depth - 1 GROUP BY d.g, d.c
), way AS (
  SELECT g, step, [step] AS path FROM depths WHERE depth = 0
  UNION ALL SELECT u.g, u.step, list_append(w.path, u.step) FROM way w JOIN up u ON u.g = w.g AND u.above = w.step
), size AS (
  SELECT g, x AS step, count(*) AS n FROM (SELECT g, unnest(path) AS x FROM way) GROUP BY g, x
), heavy AS (
  SELECT DISTINCT ON (u.g, u.above) u.g, u.above, u.step FROM up u JOIN size s ON s.g = u.g AND s.step = u.step ORDER BY u.g, u.above, s.n DESC, u.step
), place AS (
  SELECT x.g, x.step, max(x.i) AS i FROM (SELECT g, step, unnest(path) AS at, generate_subscripts(path, 1) AS i FROM way) x
  LEFT JOIN heavy h ON h.g = x.g AND h.step = x.at WHERE h.step IS NULL GROUP BY x.g, x.step
), below AS (
  SELECT a.g, a.parent AS node, count(*) AS n FROM rg a WHERE NOT EXISTS (SELECT 1 FROM rg b WHERE b.g = a.g AND b.child = a.parent AND b.parent = a.child) GROUP BY a.g, a.parent
)
SELECT n.origin, n.graph_id, n.relation, s.node, s.cycle, d.depth::INTEGER AS depth, d.roots, w.path, w.path[p.i] AS chain, (len(w.path) - p.i)::INTEGER AS chain_pos,
  coalesce(b.n, 0) AS n_descendants
FROM st s JOIN num n ON n.g = s.g JOIN depths d ON d.g = s.g AND d.step = s.step JOIN way w ON w.g = s.g AND w.step = s.step
JOIN place p ON p.g = s.g AND p.step = s.step LEFT JOIN below b ON b.g = s.g AND b.node = s.node"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_nodes": _STEPS + _HEAVY,
        "p1_paths": _STEPS
        + """SELECT n.origin, n.graph_id, n.relation, s.node, row_number() OVER (PARTITION BY s.g, s.node ORDER BY list_reverse(w.path)) - 1 AS path_no, w.path[1] AS root, w.path,
  list_filter(list_transform(w.path, lambda x, i: CASE WHEN list_contains(k.cycles, x) THEN (i - 1)::INTEGER END), lambda i: i IS NOT NULL) AS cycle_steps
FROM ways w JOIN st s ON s.g = w.g AND s.step = w.step JOIN num n ON n.g = w.g LEFT JOIN (SELECT g, list(DISTINCT cycle) AS cycles FROM cyc GROUP BY g) k ON k.g = w.g""",
        "p1_found": _REACH + "SELECT origin, graph_id, relation, child AS node FROM reach WHERE child = parent",
        "p1_descendants": _REACH
        + """SELECT origin, graph_id, relation, parent AS node, child AS descendant FROM reach a WHERE NOT EXISTS (
  SELECT 1 FROM reach b WHERE b.origin = a.origin AND b.graph_id = a.graph_id AND b.relation = a.relation AND b.child = a.parent AND b.parent = a.child)""",
    }
