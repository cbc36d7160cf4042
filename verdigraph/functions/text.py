"""String functions with the semantics of Python's str, as built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.isspace calls white space, as a class that needs no look at Unicode's tables.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def one_spaced(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


@cache
def _marks() -> tuple[str, str]:
    """For translate: letters with one base letter and marks, then marks alone (deleted)."""
    single, deleted = [], []
    for cp in range(0x80, 0x1E900):
        c = chr(cp)
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000:
            continue
        if unicodedata.category(c) == "Mn":
            deleted.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            single.append((c, base))
    return "".join(c for c, _ in single) + "".join(deleted), "".join(b for _, b in single)


def deaccent(c: Column) -> Column:
    """Without marks, as after canonical decomposition; letters that decompose to several letters are kept."""
    return F.translate(c, *_marks())


def name_key(c: Column, qualifier: str | None = None, suffixes: tuple[str, ...] = ("s",)) -> Column:
    """The key by which names are merged: case, accents, spacing, an optional qualifier and one plural suffix don't count."""
    s = strip(F.lower(c))
    if qualifier:
        s = F.regexp_replace(s, f"(?U){qualifier}", "")
    s = strip(one_spaced(deaccent(s)))
    out = s
    for suffix in reversed(suffixes):
        out = F.when((F.char_length(s) > 3) & s.endswith(suffix), F.left(s, F.char_length(s) - len(suffix))).otherwise(out)
    return out


def slug(c: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(deaccent(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", "relation").otherwise(made)


def preference(name: Column) -> Column:
    """Sorts the names of one key by preference: a capital first, then the shorter, then code point order."""
    return F.struct(name.rlike(r"^\p{IsLowercase}").alias("low"), F.char_length(name).alias("size"), name.alias("name"))
