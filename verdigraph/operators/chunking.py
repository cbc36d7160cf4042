"""Texts in chunks of whole paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigraph.functions.text import SPACE, strip


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, rf"\n{SPACE}*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def chunk_text(df: DataFrame, text: str, size: Column | int, each: Column | None = None) -> DataFrame:
    """``df`` without ``text``, with chunk_no and chunk: paragraphs joined by a blank line as long as they fit ``size``.

    A paragraph above the size is a chunk of its own; null and blank texts have none. The paragraph sizes' running fit is
    a fold over lengths alone; the chunks are then slices of the paragraphs, so no text is copied along. ``each``, an
    array of structs, has further columns (the size among them) to chunk every text by; texts are split only once.
    """
    size = F.lit(size) if isinstance(size, int) else size
    kept = [c for c in df.columns if c != text]
    parts = df.select(*kept, paragraphs(F.col(text)).alias("_p"))
    if each is not None:
        parts = parts.select(*kept, "_p", F.explode(each).alias("_e")).select(*kept, "_p", "_e.*")
        kept = [c for c in parts.columns if c != "_p"]
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def take(s: Column, length: Column) -> Column:
        full = (s["n"] > 0) & (s["n"] + length + 2 > size)
        n = F.when(full | (s["n"] == 0), length).otherwise(s["n"] + length + 2)
        ends = F.when(full, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"])
        return F.struct(n.alias("n"), (s["at"] + 1).alias("at"), ends.alias("ends"))

    lengths = F.transform("_p", F.char_length)
    ends = F.aggregate(lengths, state, take, lambda s: F.when(s["at"] > 0, F.concat(s["ends"], F.array(s["at"]))).otherwise(s["ends"]))
    cut = parts.withColumn("_ends", ends)
    # The outer form: of the plain one Spark infers a filter that would split and fold every text once more.
    cut = cut.select(*kept, "_p", "_ends", F.posexplode_outer("_ends").alias("chunk_no", "_end")).filter("chunk_no is not null")
    begin = F.when(F.col("chunk_no") == 0, 0).otherwise(F.get("_ends", F.col("chunk_no") - 1))
    return cut.select(*kept, "chunk_no", F.array_join(F.slice("_p", begin + 1, F.col("_end") - begin), "\n\n").alias("chunk"))
