"""Verdigraph: typed knowledge graphs from document collections, built on PySpark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

_HOMES = {
    "Config": "config",
    "GraphPipeline": "plans.pipeline",
    "RelationSchema": "schema",
    "RelationType": "schema",
    "ENGLISH": "schema",
    "SPANISH": "schema",
    "BUILT_IN": "schema",
    "find_schema": "schema",
    "Answer": "inference.engines",
    "Engine": "inference.engines",
    "HttpEngine": "inference.engines",
    "InferenceError": "inference.engines",
    "ReplayEngine": "inference.engines",
    "RuleEngine": "inference.engines",
    "create_engine": "inference.engines",
    "RichText": "sources.files",
    "build_view_model": "plans.viewer",
    "visualize": "plans.viewer",
    "render_html": "sources.html",
}
__all__ = [*_HOMES]


def __getattr__(name: str) -> object:
    """Names are imported when asked for: workers import parts of the package and shouldn't pay for all."""
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f"verdigraph.{_HOMES[name]}"), name)
