"""One consistent form of text that looks the same.

``visible_form(df, column)`` adds the form: two strings have the same form exactly if a reader sees the same letters,
accents, digits, signs and gaps in the same order.

Method: the Arrow text becomes one array of code points; a lookup table gives each its expansion (nothing for invisible
characters, base and marks for accented letters, a plain character for full-width forms, odd spaces, plain hyphens,
ligatures and letters drawn alike); offsets of the expansions make the new array; marks are put in canonical order and
composed with the letter before them, all at once. No string is touched one by one.

Made equal: invisible characters (format characters, variation selectors, fillers), canonically equivalent encodings,
single spaces of every kind, hyphen and non-breaking hyphen and the full-width and small ones, full-width and half-width
forms, typographic ligatures, letters of other scripts drawn as a Latin letter is.
Kept apart: case, accents, superscripts and subscripts, dashes, every different or additional ASCII character.

Defined cases: null stays null, empty stays empty; a string of invisible characters only has the empty form; texts of any
length are taken whole; other columns pass through, a column already named like the result is replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm.arrays import code_points, pieces, spans, to_text

# Letters drawn like a Latin letter: fixed values (public knowledge of the scripts' glyphs), the Latin letter first.
ALIKE = {
    # Cyrillic
    "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "ІӀ", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "Ү",
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү",
}
ALIKE_GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "F": "Ϝ", "H": "Η", "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ", "C": "Ϲ",
    "o": "ο", "v": "ν", "u": "υ", "p": "ρ", "c": "ϲ", "j": "ϳ",
}
ALIKE_OTHER = {"o": "օ", "h": "հ", "n": "ո", "u": "ս", "q": "զ", "g": "ɡց", "O": "Օ", "S": "Տ", "U": "Ս", "L": "Լ", "a": "ɑ"}
#: Plain hyphens besides the ASCII one.
HYPHENS = "‐‑﹣－"
#: Invisible, though not of the category of format characters: joiners, fillers, selectors.
HIDDEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point the start and length of its expansion in a flat array; its combining class; and composition."""
    alike = {ord(x): latin for part in (ALIKE, ALIKE_GREEK, ALIKE_OTHER) for latin, xs in part.items() for x in xs}
    hidden = set(HIDDEN)
    size = sys.maxunicode + 1
    start, length = np.arange(size, dtype=np.int64), np.ones(size, np.int64)
    more: list[int] = []
    klass = np.zeros(size, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    for cp in range(size):
        if 0xD800 <= cp < 0xE000 or cp < 0x80:
            continue
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co"):
            continue
        klass[cp] = unicodedata.combining(c)
        if cp in hidden or kind == "Cf" and not _shows(cp):
            length[cp] = 0
            continue
        whole = unicodedata.normalize("NFD", c)
        if len(whole) == 1 and whole == c:
            whole = _plain(c, cp, kind, alike)
        else:
            whole = "".join(_plain(x, ord(x), unicodedata.category(x), alike) for x in whole)
        if whole != c:
            start[cp], length[cp] = size + len(more), len(whole)
            more += map(ord, whole)
        one = unicodedata.normalize("NFC", unicodedata.normalize("NFD", c))
        parts = unicodedata.decomposition(c)
        if one == c and parts and parts[0] != "<" and " " in parts:
            a, b = (int(x, 16) for x in parts.split())
            base = alike.get(a)
            if base is None or (ord(base), b) not in pairs:
                pairs.setdefault((ord(base) if base else a, b), cp)
    for (a, b), cp in list(pairs.items()):  # the Latin composite wins over one drawn alike
        latin = unicodedata.normalize("NFC", chr(a) + chr(b))
        if len(latin) == 1:
            pairs[a, b] = ord(latin)
    keys = np.array([a << 21 | b for a, b in pairs], np.int64)
    order = np.argsort(keys)
    flat = np.concatenate((np.arange(size), np.array(more, np.int64))).astype(np.uint32)
    return start, length, klass, flat, keys[order], np.array(list(pairs.values()), np.uint32)[order]


def _shows(cp: int) -> bool:
    """Format characters that are drawn: number signs and the like, in Arabic, Syriac, Kaithi and Egyptian."""
    return 0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD) or 0x13430 <= cp <= 0x1345F


def _plain(c: str, cp: int, kind: str, alike: dict[int, str]) -> str:
    if cp in alike:
        return alike[cp]
    if c in HYPHENS:
        return "-"
    if kind == "Zs":
        return " " if cp != 0x1680 else c
    if cp == 0xB5:  # the micro sign is drawn as the Greek letter is
        return "μ"
    form = unicodedata.decomposition(c)
    if form.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06:
        whole = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
        return "".join(alike.get(ord(x), x) for x in whole)
    return c


def forms(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forms of rows given as code points end to end, and offsets."""
    start, length, klass, flat, keys, composed = tables()
    counts = length[points]
    ends = np.concatenate(([0], np.cumsum(counts)))
    out, at = flat[spans(start[points], counts)], ends[offsets]
    out, at = _syllables(out, at)
    marks = klass[out]
    if not marks.any():
        return out, at
    first = np.zeros(len(out) + 1, bool)
    first[at] = True
    first = first[:-1]
    # Canonical order: within a run of marks, by class. A run ends at a letter and at the end of a row.
    is_mark = marks > 0
    run = np.cumsum(~is_mark | first)
    loose = np.flatnonzero(is_mark)
    out[loose] = out[loose[np.lexsort((loose, marks[loose], run[loose]))]]
    # Composition: each letter with the first mark after it that isn't blocked, until none is left.
    alive = np.ones(len(out), bool)
    letter = np.maximum.accumulate(np.where(is_mark, -1, np.arange(len(out))))
    begin = at[np.searchsorted(at, loose, "right") - 1]
    loose = loose[letter[loose] >= begin]
    while len(loose):
        kinds = klass[out[loose]]
        base = letter[loose]
        # The class of the kept mark just before, of the same letter; one of the same class blocks.
        before = np.concatenate(([0], np.where(base[1:] == base[:-1], kinds[:-1], 0))) if len(loose) else kinds
        key = out[base].astype(np.int64) << 21 | out[loose]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        fits = (keys[place] == key) & ((before == 0) | (before < kinds))
        hit = np.flatnonzero(fits)
        if not len(hit):
            break
        hit = hit[np.concatenate(([True], base[hit[1:]] != base[hit[:-1]]))]
        out[base[hit]] = composed[place[hit]]
        alive[loose[hit]] = False
        keep = np.ones(len(loose), bool)
        keep[hit] = False
        loose = loose[keep]
    return out[alive], np.concatenate(([0], np.cumsum(alive)))[at]


def _syllables(out: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Korean letters put together by the standard's arithmetic."""
    lead = np.flatnonzero((out >= 0x1100) & (out < 0x1113))
    if not len(lead):
        return out, at
    row = np.searchsorted(at, np.arange(len(out)), "right")
    same = lambda i, k: (i + k < len(out)) & (row[np.minimum(i + k, len(out) - 1)] == row[i])
    value = lambda i, k: out[np.minimum(i + k, len(out) - 1)].astype(np.int64)
    lead = lead[same(lead, 1) & (value(lead, 1) >= 0x1161) & (value(lead, 1) < 0x1176)]
    tail = same(lead, 2) & (value(lead, 2) > 0x11A7) & (value(lead, 2) < 0x11C3)
    out, alive = out.copy(), np.ones(len(out), bool)
    made = 0xAC00 + ((value(lead, 0) - 0x1100) * 21 + value(lead, 1) - 0x1161) * 28 + np.where(tail, value(lead, 2) - 0x11A7, 0)
    out[lead] = made
    alive[lead + 1] = False
    alive[lead[tail] + 2] = False
    return out[alive], np.concatenate(([0], np.cumsum(alive)))[at]


def visible_form(df: DataFrame, column: str, name: str = "form") -> DataFrame:
    """``df`` with the consistent form of ``column`` as ``name``."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            text = batch.column(column)
            made = to_text(*forms(*code_points(text)[:2]))
            if text.null_count:
                made = pa.compute.if_else(text.is_valid(), made, None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, name])

    return df.mapInArrow(run, schema)


def lookalike_pairs(names: DataFrame, scope: list[str], column: str) -> DataFrame:
    """Different strings of a scope with the same form, as name_a < name_b in code point order.

    ``names`` has distinct rows of ``scope`` and ``column``. All-ASCII strings are their own form, so the kernel sees only
    the others. A form that no other string of its scope shares ends in the join, unpaired; a hot form is split by the
    join like any skewed key.
    """
    kept = names.select(*scope, F.col(column).alias("name")).filter("name is not null")
    ascii_only = ~F.col("name").rlike(r"[^\x00-\x7f]")
    made = visible_form(kept.filter(~ascii_only), "name")
    a = made.select(*scope, "form", F.col("name").alias("name_a"))
    both = a.unionByName(kept.filter(ascii_only).select(*scope, F.col("name").alias("form"), F.col("name").alias("name_a")))
    odd = made.select(*scope, "form", F.col("name").alias("name_b"))
    on = [*scope, "form"]
    # Of two different strings with one form, one at least isn't ASCII: join all with the odd ones.
    met = odd.join(both, on).filter("name_a <> name_b")
    first, second = F.least("name_a", "name_b"), F.greatest("name_a", "name_b")
    twice = ~F.col("name_a").rlike(r"[^\x00-\x7f]") | (F.col("name_a") < F.col("name_b"))  # two odd ones meet in both orders
    return met.filter(twice).select(*scope, first.alias("name_a"), second.alias("name_b"))
