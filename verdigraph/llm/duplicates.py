"""Records that differ in formatting only, collapsed and counted.

Method: byte-identical entries are collapsed first, with their number; only the distinct ones are brought to canonical
form; these are grouped again by the full canonical text and the numbers summed. Both groupings combine before the
shuffle, so a record of which a third of all rows are copies is a few rows when it moves.

The fields of an entry are the parts between ``;`` or ``|``. Of a field only what is left without white space and
punctuation (categories Z and P, tabs, line breaks) counts, whatever the case: letters that Unicode folds to one letter
are one, so all three sigmas are the same, wherever they stand; one letter never becomes two (ß isn't ss). The canonical form is the sorted array of the
fields with something left; the same fields in any order, each as often, are the same record.

Defined cases: null entries and entries without fields are no records and have no row; an entry is known by its scope and
position, so the same row again is no further copy; entries of any length are compared whole.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of an entry that a row holds at most.
BLOCK = 65_536
#: What doesn't count in a field.
IGNORED = r"[\p{Z}\p{P}\t\n\x0b\f\r\x85]+"


@cache
def _late() -> tuple[str, str]:
    """Letters in lower case that Unicode folds to another letter: ς to σ, say."""
    pairs = [(c, c.casefold()) for c in map(chr, range(0x80, 0x1E944)) if c.isalpha() and c.lower() == c != c.casefold()]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.lower() == b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Without case; what follows a letter never matters."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, *_late()))


def canonical(entry: Column) -> Column:
    """The sorted fields of an entry."""
    fields = F.transform(F.split(folded(entry), "[;|]"), lambda f: F.regexp_replace(f, IGNORED, ""))
    return F.array_sort(F.filter(fields, lambda f: f != ""))


def survivors(rows: DataFrame, scope: list[str], entry: str, position: str) -> DataFrame:
    """Distinct entries of each scope, a row per ``BLOCK`` positions: the positions they are at, and canonical form.

    A row that comes twice with one position is one entry. The positions of a row are at most ``BLOCK``, so an entry
    repeated without end is many small rows.
    """
    block = F.floor(F.col(position) / BLOCK).alias("block")
    met = rows.filter(F.col(entry).isNotNull()).groupBy(*scope, entry, block).agg(F.collect_set(position).alias("at"))
    return met.withColumn("record", canonical(F.col(entry))).filter(F.size("record") > 0)


def records(rows: DataFrame, scope: list[str], entry: str, position: str, once: bool = False) -> DataFrame:
    """One row per record: scope, record, copies, first position and the entry there.

    ``once``: no position of a scope comes twice; else repeated rows are dropped first, which shuffles them all.
    """
    rows = rows.select(*scope, entry, position).filter(F.col(entry).isNotNull())
    rows = rows if once else rows.dropDuplicates([*scope, position])
    met = rows.groupBy(*scope, entry).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("at"))
    met = met.withColumn("record", canonical(F.col(entry))).filter(F.size("record") > 0)
    return met.groupBy(*scope, "record").agg(F.sum("n").alias("copies"), F.min("at").alias("first"), F.min_by(entry, "at").alias("entry"))


def copies(rows: DataFrame, scope: list[str], entry: str, position: str) -> DataFrame:
    """scope, pos_a, pos_b: for each entry but the first of a record the first and its own position."""
    own = survivors(rows, scope, entry, position)
    several = own.groupBy(*scope, "record").agg(F.sum(F.size("at")).alias("all"), F.min(F.array_min("at")).alias("pos_a")).filter(F.col("all") > 1)
    met = own.select(*scope, "record", "at").join(several.select(*scope, "record", "pos_a"), [*scope, "record"])
    return met.select(*scope, "pos_a", F.explode("at").alias("pos_b")).filter("pos_b > pos_a")
