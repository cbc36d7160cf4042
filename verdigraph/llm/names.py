"""Queries on the names of staging graphs and on model responses: problems 2, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm import duplicates, groups, lookalikes
from verdigraph.plans.hierarchies import NOT_BLANK
from verdigraph.runtime import table


def graph_names(spark: SparkSession, folder: str) -> DataFrame:
    """graph_id, name: non-blank entities and ends of well-formed relations. A graph loaded twice has its names twice."""
    graphs = table(spark, folder, "knowledge_graph_partial").select("graph_id", "entities", "relations")
    whole = F.filter("relations", lambda r: (F.size(r) == 3) & F.forall(r, lambda x: F.coalesce(x.rlike(NOT_BLANK), F.lit(False))))
    ends = [F.transform(whole, lambda r: F.get(r, F.lit(0))), F.transform(whole, lambda r: F.get(r, F.lit(2)))]
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce("entities", none), *(F.coalesce(e, none) for e in ends)))
    return graphs.select("graph_id", F.explode(names).alias("name")).filter(F.col("name").rlike(NOT_BLANK))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalikes.lookalike_pairs(graph_names(spark, folder), ["graph_id"], "name").distinct()


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every name of a graph with its consistent form."""
    return lookalikes.visible_form(graph_names(spark, folder).distinct(), "name")


def entity_rows(spark: SparkSession, folder: str, once: bool = False) -> DataFrame:
    """graph_id, pos, entry. A graph loaded twice has its rows twice, unless ``once``."""
    graphs = table(spark, folder, "knowledge_graph_partial").select("graph_id", "entities")
    graphs = graphs.dropDuplicates(["graph_id"]) if once else graphs
    return graphs.select("graph_id", F.posexplode("entities").alias("pos", "entry"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.copies(entity_rows(spark, folder), ["graph_id"], "entry", "pos")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of a graph once, with its number of copies."""
    return duplicates.records(entity_rows(spark, folder, once=True), ["graph_id"], "entry", "pos", once=True).withColumn("record", F.array_join("record", "; "))


def same_concept(spark: SparkSession, folder: str) -> DataFrame:
    """graph_id, a, b: the links of all model responses."""
    keyed = table(spark, folder, "clean").select("graph_id", F.explode("canonical").alias("a", "aliases"))
    return keyed.select("graph_id", "a", F.explode("aliases").alias("b")).filter(F.col("b").rlike(NOT_BLANK))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """graph_id, name, group of names that are entities."""
    made = groups.consolidate(same_concept(spark, folder), ["graph_id"], "a", "b")
    entities = table(spark, folder, "knowledge_graph_partial").select("graph_id", F.explode("entities").alias("name"))
    return made.join(entities, ["graph_id", "name"], "left_semi")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    members = _members(spark, folder)
    first = members.groupBy("graph_id", "group").agg(F.min("name").alias("name_a"))
    pairs = members.join(first, ["graph_id", "group"]).filter("name <> name_a")
    return pairs.select("graph_id", "name_a", F.col("name").alias("name_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity that is linked to something, with its group (the smallest name linked, entity or not)."""
    return _members(spark, folder)


def p5_merged(spark: SparkSession, folder: str, bound: int = 2_000) -> DataFrame:
    """The same with all graphs as one scope, of names that begin with their graph, so that forests are merged in partitions of ``bound`` links."""
    of = lambda c: F.concat_ws("\t", F.lpad(F.col("graph_id").cast("string"), 12, "0"), c)
    made = groups.consolidate(same_concept(spark, folder).select(of("a").alias("a"), of("b").alias("b")), [], "a", "b", bound)
    made = made.select(F.substring("name", 1, 12).cast("long").alias("graph_id"), *[F.expr(f"substring({c}, 14)").alias(c) for c in ("name", "group")])
    entities = table(spark, folder, "knowledge_graph_partial").select("graph_id", F.explode("entities").alias("name"))
    return made.join(entities, ["graph_id", "name"], "left_semi")


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_forms": p2_forms,
        "p4_found": p4_found,
        "p4_records": p4_records,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p5_merged": p5_merged,
    }


# Letters drawn alike, and the Latin ones they look like; written out here, apart from the operator's table.
_LETTERS = [
    ("АВСЕԌНІӀЈКМОРԚЅТѴԜХҮасԁеһіјӏорԛѕѵԝхуү", "ABCEGHIIJKMOPQSTVWXYacdehijlopqsvwxyy"),  # Cyrillic
    ("ΑΒΕϜΗΙͿΚΜΝΟΡΤΧΥΖϹονυρϲϳ", "ABEFHIJKMNOPTXYZCovupcj"),  # Greek
    ("օհոսզɡցՕՏՍԼɑ", "ohnuqggOSULa"),  # Armenian and phonetic
]


def _form_sql(column: str) -> str:
    """The form of names in Latin, Greek and Cyrillic letters, by the database's own functions."""
    pairs = [pair for old, new in _LETTERS for pair in zip(old, new)]
    pairs += [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    pairs += [*zip("ёЁїЇ", "ëËïÏ"), ("µ", "μ"), *((x, "-") for x in "‐‑")]
    pairs += [(chr(c), " ") for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
    old, new = ("".join(p[i] for p in pairs).replace("'", "''") for i in (0, 1))
    out = f"translate({column}, '{old}', '{new}')"
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize(regexp_replace({out}, '\\p{{Cf}}', '', 'g'))"


_NAMES = """
WITH r AS (SELECT graph_id, unnest(relations) AS r FROM knowledge_graph_partial),
w AS (SELECT graph_id, r FROM r WHERE len(r) = 3 AND regexp_matches(r[1], '[^\\s\\pZ]') AND regexp_matches(r[2], '[^\\s\\pZ]') AND regexp_matches(r[3], '[^\\s\\pZ]')),
names AS (
  SELECT graph_id, name FROM (
    SELECT graph_id, unnest(entities) AS name FROM knowledge_graph_partial
    UNION SELECT graph_id, r[1] FROM w UNION SELECT graph_id, r[3] FROM w)
  WHERE regexp_matches(name, '[^\\s\\pZ]'))
"""


_RECORDS = r"""
WITH g AS (SELECT DISTINCT graph_id, entities FROM knowledge_graph_partial),
e AS (SELECT graph_id, unnest(entities) AS entry, generate_subscripts(entities, 1) - 1 AS pos FROM g),
k AS (SELECT graph_id, pos::INTEGER AS pos, entry, list_sort(list_filter(list_transform(string_split_regex(lower(entry), '[;|]'),
        lambda f: regexp_replace(replace(f, 'ς', 'σ'), '[\pZ\pP\s\x0b\x{85}]+', '', 'g')), lambda f: f <> '')) AS fields FROM e WHERE entry IS NOT NULL),
r AS (SELECT graph_id, pos, entry, fields, min(pos) OVER (PARTITION BY graph_id, fields) AS first FROM k WHERE len(fields) > 0)
"""

_GROUPS = r"""
WITH RECURSIVE k AS (SELECT graph_id, unnest(map_entries(canonical)) AS e FROM clean),
l AS (SELECT graph_id, e.key AS a, unnest(e.value) AS b FROM k),
w AS (SELECT * FROM l WHERE regexp_matches(b, '[^\s\pZ]')),
links AS (SELECT * FROM w UNION SELECT graph_id, b, a FROM w),
reach AS (SELECT graph_id, a, a AS b FROM links UNION SELECT r.graph_id, r.a, l.b FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.a = r.b),
entities AS (SELECT DISTINCT graph_id, unnest(entities) AS name FROM knowledge_graph_partial)
"""


def oracle_sql() -> dict[str, str]:
    grouped = _GROUPS + """SELECT r.graph_id, r.a AS name, min(r.b) AS "group" FROM reach r JOIN entities n ON n.graph_id = r.graph_id AND n.name = r.a GROUP BY ALL"""
    forms = _NAMES + f", forms AS (SELECT graph_id, name, {_form_sql('name')} AS form FROM names)"
    return {
        "p2_found": forms + " SELECT a.graph_id, a.name AS name_a, b.name AS name_b FROM forms a JOIN forms b ON a.graph_id = b.graph_id AND a.form = b.form AND a.name < b.name",
        "p2_forms": forms + " SELECT graph_id, name, form FROM forms",
        "p4_found": _RECORDS + "SELECT graph_id, first AS pos_a, pos AS pos_b FROM r WHERE pos > first",
        "p4_records": _RECORDS + """SELECT graph_id, array_to_string(fields, '; ') AS record, count(*) AS copies, first, min_by(entry, pos) AS entry
FROM r GROUP BY graph_id, fields, first""",
        "p5_found": _GROUPS + """, m AS (SELECT r.graph_id, r.a AS name, min(r.b) AS name_a FROM reach r JOIN entities n ON n.graph_id = r.graph_id AND n.name = r.b GROUP BY ALL)
SELECT m.graph_id, m.name_a, m.name AS name_b FROM m JOIN entities n ON n.graph_id = m.graph_id AND n.name = m.name WHERE m.name <> m.name_a""",
        "p5_groups": grouped,
        "p5_merged": grouped,
    }
