"""Prompts. The contracts (shapes of answers, keys, rules) are what the stages rely on; the wording is this project's."""

from __future__ import annotations

from verdigraph.schema import RelationSchema

KEEP_LANGUAGE = """LANGUAGE
Concept names stay in the language, spelling and case of the source. Nothing is translated.
Relation keys are identifiers: copy them letter by letter."""


def _preference(schema: RelationSchema) -> str:
    if schema.fallback is None:
        return "- A pair that fits none of the types has no relation: leave it out."
    return f"- Use {schema.listed(fallback=False)} wherever one of them holds; {schema.fallback} is for real links that fit none of these, not for doubt."


def _only_json(shape: str) -> str:
    return f"Answer with one JSON object of this shape and nothing else, no code fences:\n{shape}"


def extraction_parts(schema: RelationSchema) -> tuple[str, str]:
    """What stands before and after the fragment of text."""
    shape = '{"concepts": ["name"], "relations": [["source", "key", "target"]]}'
    before = f"""Read the fragment below and list the concepts of its subject and the relations between them.

CONCEPTS
- A concept could be an entry of the subject's index: a thing, method, structure, event or name; never a sentence or part of one.
- Leave out what belongs to the document and not to the subject (titles, authors, licences) and the people and objects of examples.
- One short name for each; no variants of case or number.

{KEEP_LANGUAGE}

RELATION TYPES (source first, then target)
{schema.catalogue()}

RULES
- Source and target differ, and both are among the concepts.
{_preference(schema)}
- State only what the fragment says.
- key is one of {schema.listed()}.
- A fragment without concepts gives empty lists.

{_only_json(shape)}

FRAGMENT
"""
    return before, "\n\nJSON:"


def linking_prompt(inventory: str, schema: RelationSchema) -> str:
    return f"""Below are all concepts of a subject. They were found piece by piece, so relations between far pieces are missing. Name those that hold the subject together: what needs what, what is a kind or a part of what.

{KEEP_LANGUAGE}

RELATION TYPES (source first, then target)
{schema.catalogue()}

RULES
- Source and target differ and are copied from the list.
{_preference(schema)}
- key is one of {schema.listed()}.

{_only_json('{"relations": [["source", "key", "target"]]}')}

CONCEPTS
{inventory}

JSON:"""


def cleaning_prompt(nodes: str) -> str:
    return f"""Below are the nodes of an automatically built graph, some with outgoing relations in brackets. Say which names mean the same concept and which name none.

RULES
- Under "canonical", a name of the list leads to the other names of the list that mean the same. The same: spelling, number, abbreviation, word order. Not the same: a part, a kind, a neighbour.
- Under "drop" are names that are no concept: parts of sentences, data of documents, things of examples.
- Names not mentioned stay. When in doubt, don't mention.

{_only_json('{"canonical": {"name": ["same as it"]}, "drop": ["name"]}')}

NODES
{nodes}

JSON:"""


def domains_prompt(nodes: str) -> str:
    return f"""Below are the concepts of a subject, some with outgoing relations in brackets. Divide them into domains.

RULES
- Three to eight domains with short names in the language of the concepts.
- Each concept is in exactly one domain, written as in the list. No domain for the rest.
- Under "non_taggable" are concepts so general that they say nothing about what a text is about.

{_only_json('{"domains": {"domain": ["concept"]}, "non_taggable": ["concept"]}')}

CONCEPTS
{nodes}

JSON:"""


def repair_prompt(broken: str, error: str, shape: str = "object") -> str:
    return f"""The text below should be one JSON {shape}, but: {error}

Write it again as valid JSON. Keep every value and its language; escape quotes and line breaks within strings; no fences, no comments. If nothing can be saved, answer {{}}.

TEXT
{broken}

JSON:"""
