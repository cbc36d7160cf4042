"""Command line. Exit codes: 0 done, 1 failed, 2 wrong settings."""

from __future__ import annotations

import argparse
import logging
import sys

from verdigraph.config import Config
from verdigraph.inference.engines import InferenceError
from verdigraph.plans.pipeline import GraphPipeline
from verdigraph.runtime import local_session
from verdigraph.schema import RelationSchema, find_schema
from verdigraph.sources.graphs import view_source

_OPTIONS = {
    "--relations": {"help": "a built-in vocabulary (en, es) or a JSON file; es if none is given"},
    "--host": {}, "--extraction-model": {}, "--curation-model": {}, "--repair-model": {}, "--inference-engine": {},
    "--chunk-size": {"type": int}, "--request-timeout": {"type": float}, "--max-repair-attempts": {"type": int}, "--max-evidence-relations": {"type": int},
    "--merge-qualifier-pattern": {}, "--plural-suffix": {"action": "append", "dest": "plural_suffixes"}, "--unclassified-domain": {}, "--output-dir": {},
    "--quiet": {"action": "store_true"}, "--no-pull": {"action": "store_true", "help": "don't prepare the models"},
}
_SETTINGS = ("host", "extraction_model", "curation_model", "repair_model", "inference_engine", "chunk_size", "request_timeout", "max_repair_attempts", "max_evidence_relations", "merge_qualifier_pattern", "unclassified_domain", "output_dir")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="verdigraph", description=__doc__)
    common = argparse.ArgumentParser(add_help=False)
    for name, how in _OPTIONS.items():
        common.add_argument(name, **how)
    commands = out.add_subparsers(dest="command", required=True)
    add = lambda name, what: commands.add_parser(name, parents=[common], help=what)
    for name in ("build", "all"):
        c = add(name, "documents to a staging graph" if name == "build" else "all stages")
        c.add_argument("input_dir")
        c.add_argument("-r", "--recursive", action="store_true")
        if name == "build":
            c.add_argument("-o", "--output")
    for name, what in (("clean", "merge names"), ("curate", "domains and typed groups"), ("view", "one HTML file")):
        c = add(name, what)
        c.add_argument("graph", nargs="?")
        c.add_argument("-o", "--output")
    c.add_argument("--title")
    c.add_argument("--no-open", action="store_true")
    add("relations", "print the vocabulary")
    return out


def start_logging(quiet: bool) -> None:
    """Messages of this package; of converters and of Spark's bridge only errors."""
    logging.basicConfig(level=logging.WARNING if quiet else logging.INFO, format="%(asctime)s %(levelname)s %(message)s", datefmt="%H:%M:%S")
    for name in ("pypdf", "PIL", "py4j"):
        logging.getLogger(name).setLevel(logging.ERROR)


def vocabulary(schema: RelationSchema) -> str:
    """A vocabulary as models are shown it, and a table of what outputs say of each type."""
    flags = ("directed", "acyclic", "use_in_embedding")
    rows = [("key", "verbose", *flags), *((t.key, t.verbose, *("yes" if getattr(t, f) else "no" for f in flags)) for t in schema)]
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    table = "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in rows)
    return f"{schema.catalogue()}\n\n{table}\n\n{len(schema)} types; others become: {schema.fallback or '(dropped)'}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    start_logging(args.quiet)
    try:
        schema = find_schema(args.relations)
        config = Config.of(**{k: getattr(args, k) for k in _SETTINGS}, plural_suffixes=tuple(args.plural_suffixes) if args.plural_suffixes else None)
    except (OSError, ValueError, KeyError, TypeError) as e:
        print(f"wrong settings: {e}", file=sys.stderr)
        return 2
    if args.command == "relations":
        print(vocabulary(schema))
        return 0
    try:
        pipeline = GraphPipeline(local_session(), config, schema, verbose=not args.quiet)
        if args.command == "view":
            path = pipeline.visualize(view_source(config, args.graph), args.output, args.title, show=not args.no_open)
            print(path)
            return 0
        if not args.no_pull:
            pipeline.bootstrap()
        if args.command == "build":
            pipeline.build(args.input_dir, args.output, args.recursive)
        elif args.command == "clean":
            pipeline.clean(args.graph, args.output)
        elif args.command == "curate":
            pipeline.curate(args.graph, args.output)
        elif not pipeline.build(args.input_dir, None, args.recursive):
            return 1  # nothing was built: an older graph must not be taken for it
        else:
            pipeline.clean()
            pipeline.curate()
    except (InferenceError, RuntimeError, OSError, KeyError, ValueError) as e:
        logging.getLogger("verdigraph").error("%s", e)
        return 1
    return 0
