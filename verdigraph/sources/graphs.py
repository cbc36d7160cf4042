"""Graphs as JSON files, the interchange form."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.config import Config
from verdigraph.schema import CURATED, FLAT


def load_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_json(data: dict, path: str | Path) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")


def is_curated(graph: dict) -> bool:
    return "concepts_by_domains" in graph


def check_graph(graph: dict) -> None:
    if not isinstance(graph, dict) or not (is_curated(graph) or "entities" in graph or "relations" in graph):
        raise ValueError("this JSON is no graph: it has neither concepts_by_domains nor entities or relations")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flat and curated graphs of files (a path or pattern), with their path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    kind = F.array_contains(F.json_object_keys("value"), "concepts_by_domains")
    options = {"mode": "PERMISSIVE"}
    flat = files.filter(~kind).select("path", F.from_json("value", FLAT, options).alias("g")).select("path", "g.*")
    curated = files.filter(kind).select("path", F.from_json("value", CURATED, options).alias("g")).select("path", "g.*")
    return flat, curated


def as_flat(spark: SparkSession, graph: dict) -> DataFrame:
    """One flat graph as a row; elements that aren't strings, and relations that aren't lists, are left out."""
    strings = lambda xs: [x for x in xs or [] if isinstance(x, str)]
    rels = [[x if isinstance(x, str) else None for x in r] for r in graph.get("relations") or [] if isinstance(r, list)]
    return spark.createDataFrame([(0, strings(graph.get("entities")), strings(graph.get("edges")), rels)], f"graph_id long, {FLAT}")


def as_curated(spark: SparkSession, graph: dict) -> DataFrame:
    text = json.dumps(graph, ensure_ascii=False)
    return spark.createDataFrame([(0, text)], "graph_id long, value string").select("graph_id", F.from_json("value", CURATED).alias("g")).select("graph_id", "g.*")


def view_source(config: Config, explicit: str | None = None) -> Path:
    """The given file, or that of the furthest stage there is."""
    found = [Path(explicit)] if explicit else [config.path(stage) for stage in ("curated", "cleaned", "staging")]
    for path in filter(Path.exists, found):
        return path
    raise FileNotFoundError(f"no such graph: {explicit}" if explicit else f"no graph of any stage in {config.output_dir}")
