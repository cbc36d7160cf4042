"""Operators of the stages on small cases worked out by hand."""

import io
import json
import random
import sys
import zipfile
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdigraph import cli
from verdigraph.config import Config, server_url
from verdigraph.functions.text import name_key, slug, strip
from verdigraph.inference.engines import InferenceError, ReplayEngine, RuleEngine, create_engine, prompt_key
from verdigraph.inference.repair import _Reader, parse_object, parse_with_repair
from verdigraph.operators import chunking, clean, curate, extract, graph, view
from verdigraph.operators.graph import _back
from verdigraph.plans import catalog
from verdigraph.plans.pipeline import GraphPipeline
from verdigraph.schema import DEFAULT, ENGLISH, SPANISH, RelationSchema, RelationType, find_schema
from verdigraph.sources.files import converter_of, docx_text, read_documents, source_paths
from verdigraph.sources.graphs import load_json, read_graphs, view_source
from verdigraph.sources.html import render_html

S: list[str] = []
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_name_key(spark):
    names = ["Nested lists", "Nested arrays", "O(n)", "O(log n)", "Búsqueda  Binaria ", "gas", "Bus", "Class", "Buses", None]
    assert column(spark, names, name_key) == ["nested list", "nested array", "o(n)", "o(log n)", "busqueda binaria", "gas", "bus", "clas", "buse", None]
    assert column(spark, ["Lists in Python"], lambda c: name_key(c, r"\s+in (python|java)\b")) == ["list"]


def test_slug_and_strip(spark):
    assert column(spark, ["has as a prerequisite", "Relación típica", "¿?"], slug) == ["has_as_a_prerequisite", "relacion_tipica", "relation"]
    texts = ["　 a b \x1c ", "\n", "", "x" * 10_000 + " "]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


@pytest.mark.parametrize(
    ("text", "size", "chunks"),
    [("aaa\n\nbbb\n \nccccc", 8, ["aaa\n\nbbb", "ccccc"]), ("aaa\n\nbbb\n \nccccc", 7, ["aaa", "bbb", "ccccc"]), ("abcdefgh", 3, ["abcdefgh"]), (" \n\n \n", 5, []), ("", 5, []), (None, 5, []), ("a\nb", 9, ["a\nb"])],
)
def test_chunks(spark, text, size, chunks):
    df = spark.createDataFrame([(text, "kept")], "text string, extra string")
    rows = chunking.chunk_text(df, "text", size).orderBy("chunk_no").collect()
    assert [r.chunk for r in rows] == chunks and [r.chunk_no for r in rows] == list(range(len(chunks))) and all(r.extra == "kept" for r in rows)


def test_model_relations(spark):
    raw = [[" A ", "is_a", "B"], ["A", " is_a ", "B"], ["A", "is_a"], ["A", "is_a", 3], "x", None, {"a": 1}, ["A", "is_a", " A "], ["", "is_a", "B"], ["A", "Is_A", "B"], ["A", "mentions", "B"], ["A", "is_a", "Z"]]
    said = [json.dumps({"relations": raw, "concepts": ["p", 7, " ", None, " q "]}), json.dumps({"relations": "x", "concepts": None}), "no json"]
    df = spark.createDataFrame([(x,) for x in said], "t string").select(F.try_parse_json("t").alias("v"))
    part = lambda name: df.select(F.try_variant_get("v", f"$.{name}", "variant").alias("raw"))
    kinds = ENGLISH.table(spark).withColumnRenamed("key", "relation")
    found = extract.valid_relations(extract.triples(part("relations"), "raw"), kinds, ["relation"])
    assert sorted((r.pos, r.source, r.relation, r.target) for r in found.collect()) == [(0, "A", "is_a", "B"), (1, "A", "is_a", "B"), (11, "A", "is_a", "Z")]
    inventory = spark.createDataFrame([("A",), ("B",)], "name string")
    near = extract.valid_relations(extract.triples(part("relations"), "raw"), kinds, ["relation"], inventory)
    assert sorted(r.pos for r in near.collect()) == [0, 1]
    assert sorted(r.name for r in extract.concepts(part("concepts"), "raw").collect()) == ["p", "q"]


def names(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def test_merge(spark):
    got = {r.name: r.representative for r in clean.deterministic_merge(names(spark, ["LIST", "List", "Lists", "list", "lists", "árbol", "Arbol", "9lives", "Zed"]), S).collect()}
    assert {got[n] for n in ("LIST", "List", "Lists", "list", "lists")} == {"LIST"} and got["árbol"] == "Arbol" and got["9lives"] == "9lives"


def test_aliases_and_map(spark):
    rows = spark.createDataFrame([(0, "A", ["B", None]), (1, "X", ["C", "B"])], "ord int, canon string, aliases array<string>")
    aliases = clean.alias_map(rows, names(spark, "ABC"), S)
    assert {r.name: r.target for r in aliases.collect()} == {"A": "A", "B": "C", "C": "C"}
    merged = spark.createDataFrame([(x, x) for x in "ABC"], "name string, representative string")
    nodes = clean.node_map(merged, aliases, names(spark, "C"), S)
    assert {r.name: r.canonical for r in nodes.collect()} == {"A": "A", "B": "C", "C": None}
    assert sorted(r.name for r in clean.entities(nodes, S).collect()) == ["A", "C"]
    found = spark.createDataFrame([("B", "is_a", "A"), ("C", "is_a", "A"), ("B", "is_a", "C")], "source string, relation string, target string")
    assert [tuple(r) for r in clean.apply_node_map(found, nodes, S).collect()] == [("C", "is_a", "A")]


def test_domains(spark):
    listed = spark.createDataFrame([(0, "g", "D2", "b"), (0, "g", "D2", "zz"), (0, "g", "D2", "b"), (1, "g", "D1", "b"), (1, "g", "D1", "a")], "ord int, g string, domain string, name string")
    concepts = names(spark, "abc").withColumn("g", F.lit("g"))
    got = curate.reconcile_domains(concepts, listed, ["g"], F.lit("Unclassified")).collect()
    assert sorted((r.domain, r.name) for r in got) == [("D1", "a"), ("D2", "b"), ("Unclassified", "c")]


@pytest.mark.parametrize(
    ("data", "removed"),
    [({"A": ["B"], "B": ["C"], "C": ["A"]}, [("C", "A")]), ({"A": ["A"]}, [("A", "A")]), ({"A": ["B"], "B": ["A"]}, [("B", "A")]), ({"A": ["C"], "B": ["A"], "C": ["B"]}, [("B", "A")])],
)
def test_back_edges(spark, data, removed):
    df = spark.createDataFrame([(1, s, t) for s, ts in data.items() for t in ts], "g int, source string, target string")
    assert sorted((r.source, r.target) for r in graph.back_edges(df, ["g"]).collect()) == removed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=24))
def test_back_edges_leave_no_cycle(links):
    u, v = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    n = 8
    _, (a, b) = _back(n, np.zeros(n, np.int64), u, v)
    left = set(links) - set(zip(a.tolist(), b.tolist()))
    order, todo = set(), set(range(n))
    while todo:
        free = {x for x in todo if not any(s in todo and t == x for s, t in left)}
        assert free
        todo -= free
        order |= free


def test_components_and_communities(spark):
    rng = random.Random(2)
    links = [(g, f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for g in (1, None) for _ in range(22)]
    df = spark.createDataFrame(links, "g int, source string, target string")
    lone = spark.createDataFrame([(1, "lone"), (None, "n0")], "g int, name string")
    small = {(r.g, r.name): r.component for r in graph.components(df, lone, ["g"]).collect()}
    assert small[1, "lone"] == "lone"
    for g, s, t in links:
        assert small[g, s] == small[g, t] <= min(s, t)
    one = spark.createDataFrame([x for x in links if x[0]], "g int, source string, target string")
    wide = {(r.g, r.name): r.component for r in graph.components(one, lone.filter("g = 1"), ["g"], bound=0).collect()}
    assert wide == {k: v for k, v in small.items() if k[0]}
    cliques = [(1, f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [(1, "a0", "b0")]
    got = {r.name: r.community for r in graph.communities(spark.createDataFrame(cliques, "g int, source string, target string"), lone.limit(0), ["g"]).collect()}
    assert {n: c[0] for n, c in got.items()} == {n: n[0] for n in got} and len(set(got.values())) == 2


def test_one_graph_without_scope(spark):
    n, none = 230_000, spark.createDataFrame([], "name string")
    name = lambda c: F.format_string("%06d", c)
    ring = spark.range(n).select(name(F.col("id")).alias("source"), name((F.col("id") + 1) % n).alias("target"))
    assert [tuple(r) for r in graph.back_edges(ring, S).collect()] == [("229999", "000000")]
    assert {(r.component, r["count"]) for r in graph.components(ring, none, S).groupBy("component").count().collect()} == {("000000", n)}
    star = ring.filter("source <> '000000'").select(F.lit("000000").alias("source"), F.col("source").alias("target"))
    assert {(r.community, r["count"]) for r in graph.communities(star, none, S).groupBy("community").count().collect()} == {("000000", n)}
    few = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "source string, target string")
    with mock.patch.object(graph, "contracted", wraps=graph.contracted) as joined:
        assert sorted(map(tuple, graph.components(few, none, S, bound=2).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert joined.called


def test_numbers_of_large_scopes(spark):
    rows = spark.range(5_000).select((F.col("id") % 3).alias("g"), F.format_string("n%04d", F.col("id") * 7 % 5_000).alias("name")).unionByName(spark.createDataFrame([(None, "b"), (None, "a")], "g long, name string"))
    near, far, more = ({(r.g, r.name): r.idx for r in view.numbered(rows, ["g"], ["name"], "idx", b).collect()} for b in (10**6, 300, 90))
    assert near == far == more and near[None, "b"] == 1 and sorted(v for (g, _), v in near.items() if g == 1) == list(range(1667))


def test_vocabularies(tmp_path):
    assert RelationSchema.from_dict(ENGLISH.to_dict()) == ENGLISH and DEFAULT is SPANISH
    assert ENGLISH.get("nothing") is None and "is_a" in ENGLISH and ENGLISH.listed(fallback=False) == '"prerequisite", "is_a", "part_of"'
    path = tmp_path / "v.json"
    path.write_text(json.dumps(ENGLISH.to_dict()))
    assert find_schema(str(path)) == ENGLISH and find_schema("es") is SPANISH
    for wrong in ({"key": "a b"}, {"key": ""}, {"verbose": ""}, {"definition": ""}):
        with pytest.raises(ValueError):
            RelationType(**({"key": "k", "verbose": "v", "definition": "d"} | wrong))
    kind = RelationType("k", "v", "d")
    for types, fallback in (((), None), ((kind, kind), None), ((kind,), "x")):
        with pytest.raises(ValueError):
            RelationSchema(types, fallback)


def test_config(monkeypatch):
    monkeypatch.delenv("OLLAMA_HOST", raising=False)
    assert server_url() == "http://localhost:13434" and server_url("https://x") == "https://x" and server_url("h:1") == "http://h:1" and server_url("http://127.0.0.1:5/a") == "http://127.0.0.1:5/a"
    c = Config.of(chunk_size=None, output_dir="x")
    assert c.chunk_size == 16_000 and len(c.needed_models()) == 2 and c.path("staging").name == "knowledge_graph_partial.json"
    with pytest.raises(ValueError):
        Config(plural_suffixes=("s", ""))
    with pytest.raises(InferenceError):
        create_engine(Config(inference_engine="none"))


@pytest.mark.parametrize(
    ("text", "value"),
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('Here: {"a": "x" } and more', {"a": "x"}), ('{"a": ["x", "y', {"a": ["x", "y"]}), ('{"a": {"b": 1}', {"a": {"b": 1}}), ('{"a":', {"a": None}), ('{"a": "l1\nl2"}', {"a": "l1\nl2"}),
     ("{'a': 'it', 'b': ['x']}", {"a": "it", "b": ["x"]}), ("{a: 1, b_c: 'x'}", {"a": 1, "b_c": "x"}), ('{"a": True, "b": None}', {"a": True, "b": None}), ('{"a": 1 "b": 2}', {"a": 1, "b": 2}), ('{"a": ["x" "y"]}', {"a": ["x", "y"]}),
     ('{"a": 1, // n\n "b": 2 /* c */}', {"a": 1, "b": 2}), ('{"a": "he said "hi" to me", "b": 1}', {"a": 'he said "hi" to me', "b": 1}), ('{"a": .5, "b": -1.5e3}', {"a": 0.5, "b": -1500.0}), ('Of {x, y}: {"a": 1}', {"a": 1}),
     ('{"a": "x"\n"b": "y"}', {"a": "x", "b": "y"}), ("{'a': 'don't', 'b': 1}", {"a": "don't", "b": 1}), ('{“a”: “b”}', {"a": "b"}), ('{"a": [1, 2}', {"a": [1, 2]}), ('{"u": "http://x.y/z", "b": "x, y"}', {"u": "http://x.y/z", "b": "x, y"}), ("{}", {})],
)
def test_tolerant_json(text, value):
    assert parse_object(text) == value


@pytest.mark.parametrize("text", ["", "[1]", "no", "```\n```"])
def test_no_object(text):
    with pytest.raises(ValueError):
        parse_object(text)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab \"',:{}[]\\\n/#é", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab c", min_size=1, max_size=3), x, max_size=3), max_leaves=8))
def test_reader_reads_strict_json(value):
    text = json.dumps({"k": value})
    assert _Reader(text).object().keys() == {"k"} and parse_object(text) == {"k": value}
    parse_object(text[: 1 + len(text) // 2])  # cut off anywhere: an object, or none, but no other error


def test_repair_loop():
    for bad, most, outcome in ((2, 3, ({"a": 1}, 2)), (4, 3, (None, 3)), (1, 0, (None, 0))):
        said = iter(["bad"] * (bad - 1) + ['{"a": 1}'] * 9)
        calls = []
        engine = RuleEngine(lambda m, p: calls.append(m) or next(said))
        found, error, repairs = parse_with_repair("bad", engine, "small", most)
        assert (found, repairs) == outcome and len(calls) == repairs and (error is None) == (found is not None)
    assert ReplayEngine({prompt_key("p"): "r"}).generate("m", "p").response == "r"
    with pytest.raises(InferenceError):
        ReplayEngine({}).generate("m", "p")


def answer(model, prompt):
    """A model of fixed rules."""
    if prompt.startswith("Read the fragment"):
        words = [w for w in prompt.rsplit("FRAGMENT\n", 1)[1].removesuffix("\n\nJSON:").split() if w.isalpha()]
        links = [[a, "prerequisite", b] for a, b in zip(words, words[1:])]
        return "```json\n" + json.dumps({"concepts": [*words, 7], "relations": [*links, ["x"], ["a", "unknown", "b"]]}) + "\n```"
    if prompt.startswith("Below are all concepts"):
        return json.dumps({"relations": [["Alpha", "related_to", "Gamma"], ["Alpha", "is_a", "Nobody"]]})
    if prompt.startswith("Below are the nodes"):
        assert "- Alpha  [prerequisite Beta; related_to Gamma; prerequisite Beta]" in prompt
        return json.dumps({"canonical": {"Delta": ["Gamma"]}, "drop": ["Noise"]})
    return json.dumps({"domains": {"One": ["Beta", "Alpha"], "Two": ["Alpha"], "Bad": "x"}, "non_taggable": ["Beta", "Nobody"]})


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "_a.md").write_bytes("Alpha Beta\r\n\r\nGamma Delta Gamma".encode())
    (folder / ".b.TXT").write_text("Alphas Beta Noise")
    (folder / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (folder / "skip.csv").write_text("x")
    (folder / "sub" / "c.txt").write_text("Deep")
    (folder / "p.pdf").write_bytes(b"none")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>')
    return folder


def test_sources(spark, corpus):
    assert [p.name for p in source_paths(corpus)] == [".b.TXT", "_a.md", "bad.txt", "d.docx", "p.pdf"]
    rows = {r.name: r for r in read_documents(spark, str(corpus), recursive=True).collect()}
    assert rows["_a.md"].text == "Alpha Beta\n\nGamma Delta Gamma" and rows["d.docx"].text == "# Top\n\nText" and rows["c.txt"].text == "Deep"
    assert rows["bad.txt"].text is None and "Unicode" in rows["bad.txt"].error and rows["p.pdf"].error and len(rows) == 6


def test_docx_tables():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda text, more="": f"<w:tc>{more}<w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    body = f"<w:p><w:r><w:t>Before</w:t></w:r></w:p><w:tbl><w:tr>{cell('A')}{cell('B|C')}</w:tr><w:tr>{cell('both', wide)}</w:tr></w:tbl><w:p><w:r><w:t>After</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    assert docx_text(out.getvalue()) == "Before\n\n| A | B\\|C |\n| --- | --- |\n| both |  |\n\nAfter"


def test_converter_is_made_once():
    made = []

    def make():
        made.append(1)
        return lambda content, ext: "text"

    assert converter_of(make)(b"", ".pdf") == converter_of(make)(b"", ".pdf") == "text" and made == [1]


def test_pipeline(spark, corpus, tmp_path):
    for name in ("d.docx", "p.pdf", "bad.txt"):
        (corpus / name).unlink()
    config = Config(output_dir=tmp_path / "out", chunk_size=20)
    p = GraphPipeline(spark, config, ENGLISH, RuleEngine(answer), verbose=False)
    p.bootstrap()
    staging = p.build(corpus)
    assert staging == load_json(config.path("staging"))
    assert staging["entities"] == ["Alpha", "Alphas", "Beta", "Delta", "Gamma", "Noise"] and ["Alpha", "related_to", "Gamma"] in staging["relations"]
    assert staging["edges"] == ["prerequisite", "related_to"] and ["Gamma", "prerequisite", "Delta"] in staging["relations"]
    cleaned = p.clean()
    assert cleaned["entities"] == ["Alpha", "Beta", "Delta"]
    assert cleaned["relations"] == [["Alpha", "prerequisite", "Beta"], ["Alpha", "related_to", "Delta"], ["Delta", "prerequisite", "Delta"]]
    curated = p.curate()
    assert curated["concepts_by_domains"] == {"One": ["Alpha", "Beta"], "Unclassified": ["Delta"]} and curated["generic_non_taggable_concepts"] == ["Beta"]
    assert [(g["details"]["verbose"], g["relations_data"]) for g in curated["relations"]] == [("has as a prerequisite", {"Alpha": ["Beta"]}), ("is related to", {"Alpha": ["Delta"]})]
    model = p.view_model(curated)
    assert model["nodes"] == [["Alpha", 0, 0], ["Beta", 0, 1], ["Delta", 1, 0]] and model["links"] == [[0, 1, 0], [0, 2, 1]] and model["meta"]["isolated"] == 0
    assert view_source(config) == config.path("curated") and p.visualize(config.path("curated")).read_text().startswith("<!doctype html>")
    assert p.build(tmp_path / "out") == {}
    flat, nested = read_graphs(spark, f"{config.output_dir}/*.json")
    assert flat.count() == 2 and nested.count() == 1


def test_flat_view(spark):
    graph_json = {"entities": ["A", "B", "D"], "edges": ["is_a", "related_to"], "relations": [["A", "related_to", "B"], ["B", "related_to", "A"], ["A", "is_a", "A"], ["A", "is_a", "B"], ["A", "is_a", "B"], "abc"]}
    model = GraphPipeline(spark, schema=ENGLISH, engine=RuleEngine(answer)).view_model(graph_json, "a <b> & __DATA__")
    assert model["links"] == [[0, 1, 1], [0, 1, 0]] and model["meta"]["isolated"] == 1 and [r["count"] for r in model["relations"]] == [1, 1]
    assert "<b>" not in render_html(model)
    other = GraphPipeline(spark, schema=SPANISH, engine=RuleEngine(answer)).view_model(graph_json)
    assert len(other["links"]) == 3
    with pytest.raises(ValueError):
        GraphPipeline(spark, engine=RuleEngine(answer)).view_model({"x": 1})


def test_curated_view_by_key(spark):
    group = lambda key, verbose, links: {"key": key, "details": {"verbose": verbose}, "relations_data": links}
    graph_json = {"concepts_by_domains": {"D": ["A", "B"]}, "relations": [group("related_to", "goes with", {"A": ["B"], "B": ["A"]}), group("", "is a kind of", {"A": ["B"]}), {"details": {"verbose": "of old"}, "relations_data": {"A": ["B"]}}]}
    model = GraphPipeline(spark, schema=ENGLISH, engine=RuleEngine(answer)).view_model(graph_json)
    assert [(r["key"], r["directed"], r["count"]) for r in model["relations"]] == [("related_to", False, 1), ("is_a", True, 1), ("of_old", True, 1)]


def test_flat_view_by_communities(spark, tmp_path):
    edges = [[f"{c}{i}", "related_to", f"{c}{j}"] for c in "ab" for i in range(5) for j in range(i)] + [["a0", "related_to", "b0"]]
    graphs = spark.createDataFrame([(1, "en", ["lone"], ["related_to"], edges)], "graph_id long, vocabulary string, entities array<string>, edges array<string>, relations array<array<string>>")
    graphs.write.parquet(str(tmp_path / "knowledge_graph_partial.parquet"))
    kinds = "vocabulary string, rel_key string, verbose string, ord int, directed boolean, acyclic boolean, use_in_embedding boolean"
    spark.createDataFrame([("en", "related_to", "related to", 0, False, False, True)], kinds).write.parquet(str(tmp_path / "relation_types.parquet"))
    rows = {q: catalog.queries()[q](spark, str(tmp_path)).collect() for q in ("flat_view_community_groups", "flat_view_community_nodes", "community_hubs")}
    assert sorted((r.idx, r.group, r["count"]) for r in rows["flat_view_community_groups"]) == [(0, "Cluster · a0", 5), (1, "Cluster · b0", 5), (2, "Cluster · lone", 1)]
    assert sorted((r.name, r.group_idx) for r in rows["flat_view_community_nodes"]) == [*((f"a{i}", 0) for i in range(5)), *((f"b{i}", 1) for i in range(5)), ("lone", 2)]
    assert {r.community: r.label for r in rows["community_hubs"]} == {"a0": "Cluster · a0", "b0": "Cluster · b0", "lone": "Cluster · lone"}


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["relations", "--relations", "en"]) == 0 and "part_of is part of yes no yes" in " ".join(capsys.readouterr().out.split())
    assert cli.main(["relations", "--relations", str(tmp_path / "none.json")]) == 2
    assert cli.main(["view", str(tmp_path / "none.json"), "--quiet"]) == 1
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["view", str(tmp_path / "bad.json"), "--quiet", "--no-open"]) == 1
    assert cli.main(["all", str(tmp_path), "--no-pull", "--quiet", "--output-dir", str(tmp_path)]) == 1
