"""Queries on the texts of documents: problems 3, 6, 7 and 8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm import encoding, languages, packing, splitting
from verdigraph.functions.text import SPACE
from verdigraph.runtime import checkpointed, table


def limits(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    """The limits of builder_config, a table of fixed size."""
    rows = table(spark, folder, "builder_config").select("config_id", "chunk_size", "chunk_overlap").orderBy("config_id").collect()
    return [(r.config_id, r.chunk_size, r.chunk_overlap) for r in rows]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """A paragraph is cut within exactly if it alone exceeds the size; the piece that begins it says so."""
    cut = splitting.split(table(spark, folder, "documents"), "doc_id", "text", limits(spark, folder), with_text=False)
    return cut.filter(F.col("para_first") & (F.col("cut") != "paragraph")).select("config_id", "doc_id", "para_no")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "documents"), "doc_id", "text", limits(spark, folder))


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each text that has pieces: the visible characters of what the pieces don't repeat, and pieces above the limits."""
    own = limits(spark, folder)
    most = F.create_map(*[F.lit(x) for c, size, _ in own for x in (c, size)])
    cut = splitting.split(table(spark, folder, "documents"), "doc_id", "text", own)
    new = F.regexp_replace(F.expr("substring(text, cast(repeated as int) + 1)"), SPACE, "")
    over = F.col("length") > most[F.col("config_id")]
    return cut.groupBy("config_id", "doc_id").agg(F.sum(F.char_length(new)).alias("visible"), F.count_if(over).cast("int").alias("over"), F.min("start").alias("start"))


def p3_by_tokens(spark: SparkSession, folder: str, tokenizers: str = encoding.FOLDER) -> DataFrame:
    """Pieces of at most a token budget's capacity, an eighth of it repeated."""
    budgets = table(spark, folder, "token_budgets").orderBy("budget_id").collect()  # a table of fixed size
    parts = []
    for tokenizer in sorted({b.tokenizer for b in budgets}):
        own = [(b.budget_id, b.capacity, b.capacity // 8) for b in budgets if b.tokenizer == tokenizer]
        parts.append(splitting.split(table(spark, folder, "documents"), "doc_id", "text", own, tokenizer, folder=tokenizers).withColumnRenamed("config_id", "budget_id"))
    return reduce(DataFrame.unionByName, parts)


def p6_ids(spark: SparkSession, folder: str, tokenizers: str = encoding.FOLDER) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k", tokenizers)


def p7_packed(spark: SparkSession, folder: str, tokenizers: str = encoding.FOLDER) -> DataFrame:
    """Every document, or piece of one above the capacity, in a container of every budget."""
    budgets = table(spark, folder, "token_budgets").orderBy("budget_id").collect()  # a table of fixed size
    parts = []
    for tokenizer in sorted({b.tokenizer for b in budgets}):
        sizes = checkpointed(encoding.token_counts(table(spark, folder, "documents"), "doc_id", "text", tokenizer, tokenizers))
        parts.append(packing.pack(sizes, "doc_id", "n_tokens", [(b.budget_id, b.capacity) for b in budgets if b.tokenizer == tokenizer]))
    return reduce(DataFrame.unionByName, parts)


def _languages(spark: SparkSession, folder: str, emit: str) -> DataFrame:
    return languages.identify(table(spark, folder, "documents"), "doc_id", "text", "lang", table(spark, folder, "lang_samples"), emit)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(spark, folder, "cases")


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of every document, with confidence, and what to think of its label."""
    return _languages(spark, folder, "documents")


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of one language, with confidence."""
    return _languages(spark, folder, "passages")


def queries() -> dict:
    return {
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p3_coverage": p3_coverage,
        "p3_by_tokens": p3_by_tokens,
        "p6_ids": p6_ids,
        "p7_packed": p7_packed,
        "p8_found": p8_found,
        "p8_documents": p8_documents,
        "p8_passages": p8_passages,
    }


_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x85\x{E000}]"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_coverage": rf"""
SELECT config_id, doc_id, length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS visible, 0 AS over, length(regexp_extract(text, '^{_SPACE}*')) AS start
FROM documents, builder_config WHERE regexp_matches(text, '[^' || substring('{_SPACE}', 2))""",
        # A carriage return before a line feed is kept as one more blank character, so that lengths stay.
        "p3_found": rf"""
WITH t AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10) || chr(57344)), chr(13), chr(10)) AS text FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n{_SPACE}*\n{_SPACE}*'),
        lambda x: regexp_replace(regexp_replace(x, '^{_SPACE}+', ''), '{_SPACE}+$', '')), lambda x: x <> '') AS ps FROM t),
n AS (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) - 1 AS para_no FROM p)
SELECT config_id, doc_id, para_no::INTEGER AS para_no FROM n JOIN builder_config c ON length(para) > c.chunk_size""",
    }
