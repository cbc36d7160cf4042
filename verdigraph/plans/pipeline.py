"""The stages from documents to a curated graph."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.config import Config
from verdigraph.functions import prompts
from verdigraph.inference.calls import ask, parsed, recorded
from verdigraph.inference.engines import Engine, create_engine, prepare
from verdigraph.inference.repair import parse_with_repair
from verdigraph.operators import chunking, clean, curate, extract, graph
from verdigraph.plans.viewer import build_view_model
from verdigraph.runtime import new_folder
from verdigraph.schema import DEFAULT, RelationSchema
from verdigraph.sources.files import Converter, RichText, read_documents
from verdigraph.sources.graphs import as_flat, check_graph, load_json, save_json
from verdigraph.sources.html import write_html

log = logging.getLogger("verdigraph")
G = ["graph_id"]
#: Unreadable files that are named in the log.
SHOWN = 20


def _dict(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _strings(x: object) -> list[str]:
    return [v for v in x if isinstance(v, str)] if isinstance(x, list) else []


class GraphPipeline:
    """``build``, ``clean`` and ``curate`` read and write the stages' files; their tables are there for larger use."""

    def __init__(self, spark: SparkSession, config: Config | None = None, schema: RelationSchema | None = None, engine: Callable[[], Engine] | Engine | None = None, converter: Callable[[], Converter] | None = None, verbose: bool = True) -> None:
        self.spark, self.config, self.schema, self.converter = spark, config or Config(), schema or DEFAULT, converter or RichText()
        settings = self.config
        self.engine = (lambda: create_engine(settings)) if engine is None else engine if callable(engine) and not hasattr(engine, "generate") else (lambda: engine)
        log.setLevel(logging.INFO if verbose else logging.ERROR)

    def bootstrap(self) -> None:
        prepare(self.engine(), self.config)

    @property
    def _kinds(self) -> DataFrame:
        return self.schema.table(self.spark).withColumnRenamed("key", "relation")

    def _ask_one(self, prompt: str, model: str) -> dict:
        """The object a single prompt gives; {} if it can't be had."""
        own = self.engine()
        said = own.generate(model, prompt, think=False).response
        found, error, _ = parse_with_repair(said, own, self.config.repair_model, self.config.max_repair_attempts)
        if found is None:
            log.warning("no usable answer: %s", error)
        return found or {}

    def extract_tables(self, documents: DataFrame, calls_folder: str) -> tuple[DataFrame, DataFrame]:
        """Concepts (name) and triples (source, relation, target) of documents (doc_id, text). Calls are kept in a folder."""
        before, after = prompts.extraction_parts(self.schema)
        chunks = chunking.chunk_text(documents.select("doc_id", "text").filter("text is not null"), "text", self.config.chunk_size)
        asked = chunks.withColumn("prompt", F.concat(F.lit(before), F.col("chunk"), F.lit(after))).drop("chunk")
        c = self.config
        log.info("asking for concepts and relations")
        calls = parsed(recorded(ask(asked, "prompt", self.engine, c.extraction_model, c.repair_model, c.max_repair_attempts), calls_folder))
        counts = calls.agg(F.count(F.lit(1)), F.count_if(F.col("repairs") > 0), F.count_if(F.col("object").isNull())).first()
        log.info("%d chunks, %d answers repaired, %d without an object", *counts)
        part = lambda name: calls.select(F.try_variant_get("v", f"$.{name}", "variant").alias("raw"))
        names = extract.concepts(part("concepts"), "raw").distinct()
        found = extract.valid_relations(extract.triples(part("relations"), "raw"), self._kinds, ["relation"])
        return names, extract.distinct_triples(found, [])

    def link_global(self, names: DataFrame) -> DataFrame:
        """Triples that one prompt over all names gives; none for fewer than two names."""
        listed = [r.name for r in names.orderBy("name").collect()]  # the prompt has them all: one engine's context
        found = _dict(self._ask_one(prompts.linking_prompt("\n".join(f"- {n}" for n in listed), self.schema), self.config.extraction_model)) if len(listed) > 1 else {}
        raw = self.spark.createDataFrame([(json.dumps(found.get("relations")),)], "t string").select(F.try_parse_json("t").alias("raw"))
        valid = extract.valid_relations(extract.triples(raw, "raw"), self._kinds, ["relation"], names)
        return extract.distinct_triples(valid, [])

    def build(self, input_dir: str | Path, output: str | Path | None = None, recursive: bool = False) -> dict:
        """Files to a staging graph. {} and no file if there is nothing to read or to find."""
        folder = new_folder(self.spark)  # of the cluster: documents are converted, and models asked, once
        docs = recorded(read_documents(self.spark, str(input_dir), recursive, self.converter).withColumnRenamed("path", "doc_id"), f"{folder}/documents")
        bad = docs.filter("error is not null")
        n, wrong = docs.count(), bad.count()
        log.info("%d files, %d of them unreadable", n, wrong)
        for r in bad.select("doc_id", "error").orderBy("doc_id").limit(SHOWN).collect():
            log.error("%s skipped: %s", r.doc_id, r.error)
        names, found = self.extract_tables(docs.filter("error is null"), f"{folder}/calls")
        if names.isEmpty():
            log.error("nothing to read, or no concept found, in %s", input_dir)
            return {}
        names = extract.universe(names, found, [])
        before = found.count()
        found = found.unionByName(self.link_global(names)).distinct()
        out = self._flat(names, found)
        log.info("%d relations in chunks, %d more between them", before, len(out["relations"]) - before)
        save_json(out, output or self.config.path("staging"))
        log.info("staging: %d entities, %d relations", len(out["entities"]), len(out["relations"]))
        return out

    def _flat(self, names: DataFrame, found: DataFrame) -> dict:
        one = F.lit(0).cast("long").alias("graph_id")
        row = extract.flat_graph(names.select(one, "name"), found.select(one, "source", "relation", "target"), G).first()
        return {"entities": list(row.entities), "edges": list(row.edges), "relations": [list(r) for r in row.relations]} if row else {"entities": [], "edges": [], "relations": []}

    def _lines(self, names: DataFrame, found: DataFrame, merged: DataFrame | None = None) -> str:
        proof = clean.evidence(found, G, self.config.max_evidence_relations, merged)
        return "\n".join(r.line for r in clean.node_lines(names, proof, G).orderBy("name").collect())

    def _load(self, path: str | Path) -> tuple[DataFrame, DataFrame]:
        graph_json = load_json(path)
        check_graph(graph_json)
        row = as_flat(self.spark, graph_json)
        return row.select("graph_id", F.explode("entities").alias("name")).distinct(), extract.array_triples(row, "relations", "graph_id")

    def clean(self, staging: str | Path | None = None, output: str | Path | None = None) -> dict:
        """A staging graph with names merged, mechanically and as proposed."""
        listed, found = self._load(staging or self.config.path("staging"))
        names = extract.universe(listed, found, G)
        merged = clean.deterministic_merge(names, G, self.config.merge_qualifier_pattern, self.config.plural_suffixes)
        valid = merged.select("graph_id", F.col("representative").alias("name")).distinct()
        log.info("%d entities, %d relations, %d names; %d when merged", listed.count(), found.count(), names.count(), valid.count())
        said = self._ask_one(prompts.cleaning_prompt(self._lines(valid, found, merged)), self.config.curation_model)
        rows = [(0, i, k, _strings(v)) for i, (k, v) in enumerate(_dict(said.get("canonical")).items())]
        proposed = self.spark.createDataFrame(rows, "graph_id long, ord int, canon string, aliases array<string>")
        drops = self.spark.createDataFrame([(0, d) for d in _strings(said.get("drop"))], "graph_id long, name string")
        nodes = clean.node_map(merged, clean.alias_map(proposed, valid, G), drops, G)
        out = self._flat(clean.entities(nodes, G), clean.apply_node_map(found, nodes, G))
        save_json(out, output or self.config.path("cleaned"))
        log.info("cleaned: %d entities, %d relations", len(out["entities"]), len(out["relations"]))
        return out

    def curate(self, cleaned: str | Path | None = None, output: str | Path | None = None) -> dict:
        """A flat graph with concepts in domains and relations in typed groups without forbidden cycles."""
        concepts, found = self._load(cleaned or self.config.path("cleaned"))
        said = self._ask_one(prompts.domains_prompt(self._lines(concepts, found)), self.config.curation_model)
        rows = [(0, i, d, n) for i, (d, ns) in enumerate(_dict(said.get("domains")).items()) if isinstance(ns, list) for n in _strings(ns)]
        proposed = self.spark.createDataFrame(rows, "graph_id long, ord int, domain string, name string")
        domains = curate.reconcile_domains(concepts, proposed, G, F.lit(self.config.unclassified_domain))
        raw = self.spark.createDataFrame([(0, n) for n in _strings(said.get("non_taggable"))], "graph_id long, name string")
        kinds = self._kinds
        typed = curate.typed_relations(found, concepts, kinds, ["relation"], G)
        whole = typed.select("graph_id", "ord", "relation").distinct()
        before = typed.count()
        typed = graph.break_cycles(typed, kinds, ["relation"], G)
        log.info("%d concepts, %d of them in no domain; %d typed relations, %d of them closed cycles", concepts.count(), domains.filter("leftover").count(), before, before - typed.count())
        details = kinds.select("relation", F.struct("verbose", "directed", "acyclic", "use_in_embedding").alias("details"))
        row = curate.curated_graph(domains, curate.non_taggable(raw, concepts, G), typed, details, G).first()
        left = {g.details.verbose: dict(g.relations_data) for g in (row.relations or [])} if row else {}
        groups = []
        for r in whole.orderBy("ord").collect():  # a kind that lost all relations stays, empty
            kind = self.schema[r.relation]
            groups.append({"details": kind.details(), "relations_data": left.get(kind.verbose, {})})
        out = {"concepts_by_domains": dict(row.concepts_by_domains) if row else {}, "generic_non_taggable_concepts": list((row.generic_non_taggable_concepts if row else None) or []), "relations": groups}
        save_json(out, output or self.config.path("curated"))
        log.info("curated: %d domains, %d groups", len(out["concepts_by_domains"]), len(groups))
        return out

    def view_model(self, graph_json: dict, title: str = "Knowledge graph", source: str = "") -> dict:
        return build_view_model(self.spark, graph_json, self.schema, title, source)

    def visualize(self, path: str | Path, output: str | Path | None = None, title: str | None = None, show: bool = False) -> Path:
        path = Path(path)
        model = self.view_model(load_json(path), title or path.stem.replace("_", " "), path.name)
        out = write_html(model, output or self.config.path("viewer"), show)
        log.info("viewer: %d nodes, %d links, %d groups, %d relation types in %s", *(len(model[k]) for k in ("nodes", "links", "groups", "relations")), out)
        return out
