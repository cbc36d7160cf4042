"""Splitting oversized texts at natural boundaries.

``split(df, limits, ...)`` cuts each text, for each limit (config_id, size, overlap), into numbered pieces of at most
``size``. A cut is made at the last paragraph end under the limit; where there is none, at the last line end, sentence
end or word end; else anywhere. Each piece but the first begins up to ``overlap`` before the end of the piece before it,
at the start of a word where there is one; less is repeated where that lets the next paragraph fit whole. So a paragraph
is cut exactly if it alone exceeds the size.

Method: the batch is one array of code points; prefix sums over the offsets of its tokens give the size of any stretch
(``unit`` "chars": a code point is a token; "bytes": each of its bytes is; else the tokens of the vocabulary of that name
in the whole text's encoding); the ends of paragraphs, lines, sentences and words are sorted arrays; the last boundary
under the limit is found by binary search, for all texts of the batch at once, piece after piece.

By a vocabulary, pieces begin and end where tokens do: a blank that is one token with the word after it goes with the
word. A piece that isn't cut within a word is encoded, alone, to exactly these tokens.

A paragraph is what lies between blank lines (lines of nothing but white space, Unicode's included), without white space
at both ends. White space between two pieces belongs to neither.

Defined cases: null, empty and blank texts have no piece; a text under the limit is one piece; long texts are taken
whole; a size below 1, or an overlap that is negative or not below the size, is refused; a null overlap is 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm import encoding
from verdigraph.llm.arrays import code_points, pieces, spans, to_text

#: Kinds of cuts.
KINDS = ("paragraph", "line", "sentence", "word", "hard")
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


@cache
def white() -> np.ndarray:
    """Which code points str.isspace calls white space."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return out


class Layout:
    """Where the visible characters, and the ends of words, sentences, lines and paragraphs of a batch are."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray) -> None:
        seen = np.flatnonzero(~white()[points])
        breaks = (points == 10) | ((points == 13) & (np.append(points[1:], 0) != 10))
        count = np.cumsum(breaks, dtype=np.int64)
        row = np.searchsorted(offsets, seen, "right") - 1
        # A gap lies after a visible character: white space follows, or the row ends.
        last = np.append(row[1:] != row[:-1], True) if len(seen) else np.zeros(0, bool)
        nxt = np.append(seen[1:], len(points))
        gap = last | (nxt - seen > 1)
        lines = count[np.maximum(nxt - 1, 0)] - count[seen]  # line breaks within the gap
        ends = gap & (last | (lines > 1))
        self.ends: dict[str, np.ndarray] = {}
        stop = np.isin(points[seen], _STOPS)
        for kind, at in (("paragraph", ends), ("line", gap & (last | (lines > 0))), ("sentence", gap & (last | stop)), ("word", gap)):
            self.ends[kind] = seen[at] + 1
        first = np.append(True, gap[:-1]) if len(seen) else gap
        self.words = seen[first]
        opens = np.append(True, ends[:-1]) if len(seen) else gap
        self.paragraphs = seen[opens]
        self.row_of = row[opens]
        self.seen = seen


class Sizes:
    """Prefix sums of tokens: ``sums[i]`` begin before code point i; ``edges`` are the code points where a token begins."""

    def __init__(self, sums: np.ndarray, edges: np.ndarray) -> None:
        self.sums, self.edges = sums, edges

    @staticmethod
    def of(text: pa.Array, at_byte: np.ndarray, unit: str, folder: str) -> Sizes:
        n = len(at_byte)
        if unit in ("chars", "bytes"):
            return Sizes(np.arange(n) if unit == "chars" else at_byte, np.arange(n))
        v = encoding.vocabulary(encoding.path_of(unit, folder))
        words, _ = v.words_of(text)
        length = v.sizes[v.flat[encoding.spans(v.at[words], v.count[words])]]
        begins = np.cumsum(length) - length
        sums = np.searchsorted(begins, at_byte)
        return Sizes(sums, np.flatnonzero(np.append(begins, at_byte[-1])[sums] == at_byte))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.sums[b] - self.sums[a]

    def down(self, at: np.ndarray) -> np.ndarray:
        """The last edge up to here."""
        return at if len(self.edges) == len(self.sums) else self.edges[np.searchsorted(self.edges, at, "right") - 1]

    def up(self, at: np.ndarray) -> np.ndarray:
        """The first edge from here on."""
        return at if len(self.edges) == len(self.sums) else self.edges[np.searchsorted(self.edges, at)]

    def reach(self, start: np.ndarray, size: int) -> np.ndarray:
        """How far a piece of at most ``size`` goes."""
        return np.searchsorted(self.sums, self.sums[start] + size, "right") - 1

    def back(self, stop: np.ndarray, size: int) -> np.ndarray:
        """How far back ``size`` goes."""
        return self.up(np.searchsorted(self.sums, self.sums[stop] - size))


def cut(layout: Layout, sizes: Sizes, size: int, overlap: int) -> dict[str, np.ndarray]:
    """All pieces: row, piece_no, start, fresh (where what isn't repeated starts), stop, kind, paragraph (its number in the batch)."""
    paragraphs, ends = layout.paragraphs, layout.ends["paragraph"]
    if not len(paragraphs):
        return {k: np.zeros(0, np.int64) for k in ("row", "piece_no", "start", "fresh", "stop", "kind", "paragraph")}
    words = sizes.down(layout.words)
    new_row = np.append(True, layout.row_of[1:] != layout.row_of[:-1])
    row = layout.row_of[new_row]
    fresh = paragraphs[new_row]
    final = ends[np.append(np.flatnonzero(new_row)[1:], len(paragraphs)) - 1]
    start, number = sizes.down(fresh), 0
    out: list[tuple[np.ndarray, ...]] = []
    while len(row):
        paragraph = np.searchsorted(paragraphs, fresh, "right") - 1
        limit = sizes.down(np.minimum(sizes.reach(start, size), final))  # never into the next text
        stop, kind = limit, np.full(len(row), len(KINDS) - 1)
        stop = np.where(stop <= fresh, sizes.up(fresh + 1), stop)  # a character larger than the size stays whole
        open_ = np.ones(len(row), bool)
        for k, name in enumerate(KINDS[:-1]):
            if not open_.any():
                break
            of = layout.ends[name]
            best = of[np.maximum(np.searchsorted(of, limit[open_], "right") - 1, 0)]
            good = (best > fresh[open_]) & (best <= limit[open_])
            where = np.flatnonzero(open_)[good]
            stop[where], kind[where] = best[good], k
            open_[where] = False
        out.append((row, np.full(len(row), number), start, fresh, stop, kind, paragraph))
        going = stop < final
        row, before, stop, final = row[going], start[going], stop[going], final[going]
        if not len(row):
            break
        fresh = layout.seen[np.searchsorted(layout.seen, stop)]
        new = np.maximum(sizes.down(fresh), stop)
        start = np.maximum(sizes.back(stop, overlap), before) if overlap else new
        if overlap:
            next_end = ends[np.searchsorted(paragraphs, fresh, "right") - 1]
            whole = sizes.between(new, next_end) <= size  # then repeat no more than lets it fit
            start = np.where(whole, np.maximum(start, sizes.back(next_end, size)), start)
            word = words[np.minimum(np.searchsorted(words, start), len(words) - 1)]
            start = np.where((word >= start) & (word < stop), word, start)
            # Nothing but white space would be repeated, or the gap leaves no room: begin with what is new.
            start = np.where((start >= stop) | (sizes.reach(start, size) <= fresh), new, start)
        number += 1
    row, piece, start, fresh, stop, kind, paragraph = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((piece, row))
    return {k: v[order] for k, v in zip(("row", "piece_no", "start", "fresh", "stop", "kind", "paragraph"), (row, piece, start, fresh, stop, kind, paragraph))}


def split(df: DataFrame, key: str, column: str, limits: list[tuple[int, int, int | None]], unit: str = "chars", with_text: bool = True, folder: str = encoding.FOLDER) -> DataFrame:
    """Rows (config_id, key, piece_no, start, repeated, length, size, cut, para_no, para_first, para_length[, text]).

    start, repeated and length are in code points, size in the unit; para_no is the paragraph that the new part of the
    piece begins in, para_first whether it begins it, para_length the paragraph's size.
    """
    for config, size, overlap in limits:
        if size is None or size < 1 or not 0 <= (overlap or 0) < size:
            raise ValueError(f"config {config}: size {size}, overlap {overlap}")
    fields = "piece_no int, start long, repeated long, length long, size long, cut string, para_no int, para_first boolean, para_length long" + ", text string" * with_text
    schema = T.StructType([T.StructField("config_id", T.IntegerType()), T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column):
            points, offsets, at_byte = code_points(batch.column(column))
            layout = Layout(points, offsets)
            sizes = Sizes.of(batch.column(column), at_byte, unit, folder)
            first = np.searchsorted(layout.row_of, np.arange(batch.num_rows))
            for config, size, overlap in limits:
                c = cut(layout, sizes, size, overlap or 0)
                p, row = c["paragraph"], c["row"]
                columns = [
                    pa.array(np.full(len(row), config, np.int32)),
                    batch.column(key).take(pa.array(row)),
                    pa.array(c["piece_no"].astype(np.int32)),
                    pa.array(c["start"] - offsets[row]),
                    pa.array(np.maximum(c["fresh"] - c["start"], 0)),
                    pa.array(c["stop"] - c["start"]),
                    pa.array(sizes.between(c["start"], c["stop"])),
                    pa.array(KINDS).take(pa.array(c["kind"])),
                    pa.array((p - first[row]).astype(np.int32)),
                    pa.array(c["fresh"] == layout.paragraphs[p]),
                    pa.array(sizes.between(sizes.down(layout.paragraphs[p]), layout.ends["paragraph"][p])),
                ]
                if with_text:
                    length = c["stop"] - c["start"]
                    columns.append(to_text(points[spans(c["start"], length)], np.concatenate(([0], np.cumsum(length)))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(key, column).filter(F.col(column).isNotNull()).mapInArrow(run, schema)
