"""Encoding of a corpus with a public byte-level BPE vocabulary.

``encode(df, ...)`` gives each text its token ids, ``token_counts`` their number. Vocabularies are files of lines "base64
of a token, rank"; their folder is a parameter, and every executor reads the file itself.

Method: the texts of a batch are one array of code points; the vocabulary's split pattern is worked out on arrays of
character classes; each distinct word is merged once. The words to merge are rows of a matrix: part boundaries and the
ranks of adjacent parts lie contiguously, the minimum of each row is found by a scan, its boundary deleted, the ranks of
the two neighbours refreshed, until no row has a pair left. A word longer than ``SHORT`` bytes is merged alone with a
heap, as scanning it over and over would take time in its square.

Defined cases: null and empty texts have the empty list; strings that look like special tokens are ordinary text; texts
of any length are encoded whole; repeated texts have equal lists; extra columns aren't touched.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdigraph.llm.arrays import code_points, pieces, spans

FOLDER = "/opt/tokenizers"
#: Bytes of a word up to which words are merged together, in a matrix.
SHORT = 64
#: Words kept in a worker's memory.
KEPT = 1_000_000
NONE = np.int64(1 << 40)

LETTER, NUMBER, SPACE = 1, 2, 3
# White space by Unicode's property: fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def kinds() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x32400):
        first = unicodedata.category(chr(c))[0]
        out[c] = LETTER if first == "L" else NUMBER if first == "N" else 0
    out[WHITE] = SPACE
    return out


def word_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words begin that 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ finds."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 3, bool)
    first[offsets] = True
    first[n:] = True
    kind = kinds()[points]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space before a word is a word of its own, or if it is a blank, the beginning of the next.
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[ends] = True
    start[ends[points[ends] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & start)
    near = np.concatenate((points, [0, 0]))
    one, two = near[quote + 1], near[quote + 2]
    in1 = ~first[quote + 1]
    in2 = in1 & ~first[quote + 2]
    short = in1 & np.isin(one, [ord(c) for c in "stmd"])
    long = in2 & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
    for which, size in ((short, 2), (long, 3)):
        q = quote[which]
        start[q + 1] = False
        after = q + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a byte-level vocabulary, and the words merged so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)  # bytes of each token
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.base = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.count = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (a >= 0) & (b >= 0), self.made[place], NONE)

    def add(self, words: list[str]) -> None:
        raw = sorted(((w.encode("utf-8"), w) for w in words), key=lambda x: len(x[0]))
        counts, flats, at = [], [], 0
        while at < len(raw) and len(raw[at][0]) <= SHORT:
            width = len(raw[at][0])
            end = at
            while end < len(raw) and end < at + 20_000 and len(raw[end][0]) <= min(SHORT, max(width + 4, 8)):
                end += 1
            count, flat = self.merge_short([r for r, _ in raw[at:end]])
            counts.append(count)
            flats.append(flat)
            at = end
        for r, _ in raw[at:]:
            ids = self.merge_long(r)
            counts.append(np.array([len(ids)]))
            flats.append(np.array(ids))
        base = len(self.known)
        for k, (_, w) in enumerate(raw):
            self.known[w] = base + k
        self.count = np.concatenate((self.count, *counts))
        self.flat = np.concatenate((self.flat, *(f.astype(np.int32) for f in flats)))
        self.at = np.cumsum(self.count) - self.count

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max()) + 1
        raw = np.frombuffer(b"".join(words), np.uint8)
        parts = np.full((len(words), width), -1, np.int64)
        parts[np.repeat(np.arange(len(words)), lengths), spans(np.zeros(len(words), np.int64), lengths)] = self.base[raw]
        ranks = np.full(parts.shape, NONE)
        ranks[:, :-1] = self.rank_of(parts[:, :-1], parts[:, 1:])
        done_rows, done_parts = [], []
        rows = np.arange(len(words))
        place = np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), best]
            open_ = least < NONE
            if not open_.all():
                done_rows.append(rows[~open_])
                done_parts.append(parts[~open_])
                rows, parts, ranks, best, least = rows[open_], parts[open_], ranks[open_], best[open_], least[open_]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            # Delete the boundary after the best part: everything beyond moves one place.
            source = np.minimum(place + (place > best[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            parts[:, -1] = -1
            ranks[:, -1] = NONE
            parts[each, best] = least
            ranks[each, best] = self.rank_of(least, parts[each, np.minimum(best + 1, width - 1)])
            left = best > 0
            ranks[each[left], best[left] - 1] = self.rank_of(parts[each[left], best[left] - 1], least[left])
        order = np.argsort(np.concatenate(done_rows))
        parts = np.concatenate(done_parts)[order]
        held = parts >= 0
        return held.sum(axis=1), parts[held]

    def merge_long(self, word: bytes) -> list[int]:
        ids: list[int] = self.base[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        pair = dict(zip(self.keys.tolist(), self.made.tolist())) if not hasattr(self, "_pair") else self._pair
        self._pair = pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
                if (q := pair.get(r << 20 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            if prev[i] >= 0 and (q := pair.get(ids[prev[i]] << 20 | r)) is not None:
                heapq.heappush(heap, (q, prev[i], ids[prev[i]], r))
        return [x for x in ids if x >= 0]

    def words_of(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all rows as places in this vocabulary's tables, and the offsets of the rows in them."""
        points, offsets, at_byte = code_points(text)
        starts = word_starts(points, offsets)
        row_at = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(points))
        if len(self.known) > KEPT:
            self.clear()
        out = np.empty(len(starts), np.int64)
        for a in range(0, len(starts), 500_000):
            b = min(len(starts), a + 500_000)
            base = int(starts[a])
            whole = points[base : ends[b - 1]].tobytes().decode("utf-32-le")
            words = [whole[i:j] for i, j in zip((starts[a:b] - base).tolist(), (ends[a:b] - base).tolist())]
            if new := set(words).difference(self.known):
                self.add(sorted(new))
            out[a:b] = np.fromiter(map(self.known.__getitem__, words), np.int64, b - a)
        return out, row_at


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def path_of(tokenizer: str, folder: str = FOLDER) -> str:
    if tokenizer not in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        raise ValueError(f"not a byte-level vocabulary with ranks: {tokenizer}")
    return f"{folder}/{tokenizer}.tiktoken"


def encode(df: DataFrame, key: str, column: str, tokenizer: str, folder: str = FOLDER, name: str = "ids") -> DataFrame:
    """Rows of ``key`` and the ids of ``column``."""
    path = path_of(tokenizer, folder)
    schema = T.StructType([df.schema[key], T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in pieces(batches, column):
            words, row_at = v.words_of(batch.column(column))
            count = v.count[words]
            ids = v.flat[spans(v.at[words], count)]
            at = np.concatenate(([0], np.cumsum(count)))[row_at]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(key), lists], [key, name])

    return df.select(key, column).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, column: str, tokenizer: str, folder: str = FOLDER, name: str = "n_tokens") -> DataFrame:
    """Rows of ``key`` and the number of ids of ``column``."""
    path = path_of(tokenizer, folder)
    schema = T.StructType([df.schema[key], T.StructField(name, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in pieces(batches, column):
            words, row_at = v.words_of(batch.column(column))
            sums = np.concatenate(([0], np.cumsum(v.count[words])))[row_at]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(sums))], [key, name])

    return df.select(key, column).mapInArrow(run, schema)
