"""Pieces: never above the limit, nothing lost, cut where they should be."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdigraph.llm.arrays import code_points
from verdigraph.llm.encoding import FOLDER, path_of, vocabulary
from verdigraph.llm.splitting import KINDS, Layout, Sizes, cut, split

WORDS = ["a", "bb.", "ccc", "dddddddd", "é!", "中" * 7, "x" * 30, "\n", "\n\n", "\r\n \r\n", " ", "　", "\xa0\n \n", "\r", "\t"]


def paragraphs(text):
    """Start and end of each, by the definition."""
    out, at, line = [], None, 0
    last = 0
    for m in re.finditer(r"[^\r\n]*(\r\n|\r|\n|$)", text):
        body = m.group(0)[: len(m.group(0)) - len(m.group(1))]
        if body.strip():
            start = m.start() + len(body) - len(body.lstrip())
            at = start if at is None else at
            last = m.start() + len(body.rstrip())
        elif at is not None:
            out.append((at, last))
            at = None
        if m.end() == len(text) and not m.group(1):
            break
    return out + ([(at, last)] if at is not None else [])


@pytest.mark.parametrize("unit", ["chars", "bytes"])
def test_pieces(unit):
    rng = random.Random(4)
    texts = ["".join(rng.choice(WORDS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "x", " "]
    points, offsets, at_byte = code_points(pa.array(texts))
    layout = Layout(points, offsets)
    sums = at_byte if unit == "bytes" else np.arange(len(points) + 1)
    for size, overlap in ((40, 12), (40, 0), (17, 5), (400, 30)):
        c = cut(layout, Sizes.of(pa.array(texts), at_byte, unit, ""), size, overlap)
        by = {}
        for k in range(len(c["row"])):
            by.setdefault(int(c["row"][k]), []).append({n: int(v[k]) for n, v in c.items()})
        for i, text in enumerate(texts):
            base, own, parts = int(offsets[i]), paragraphs(text), by.get(i, [])
            assert bool(parts) == bool(text.strip())
            covered, cut_in = set(), set()
            for j, p in enumerate(parts):
                assert sums[p["stop"]] - sums[p["start"]] <= size and p["piece_no"] == j and p["stop"] > p["fresh"] >= p["start"]
                if j:
                    before = parts[j - 1]
                    assert p["fresh"] >= before["stop"] and p["start"] >= before["start"]
                    if p["start"] < before["stop"]:
                        assert sums[before["stop"]] - sums[p["start"]] <= overlap
                    assert overlap or p["start"] == p["fresh"]
                covered |= set(range(p["fresh"] - base, p["stop"] - base))
                ends = [e for _, e in own]
                assert (KINDS[p["kind"]] == "paragraph") == (p["stop"] - base in ends)
                if KINDS[p["kind"]] != "paragraph":
                    cut_in.add(next(k for k, (s, e) in enumerate(own) if s < p["stop"] - base < e))
            assert covered >= {k for k, ch in enumerate(text) if not ch.isspace()}
            assert cut_in == {k for k, (s, e) in enumerate(own) if sums[base + e] - sums[base + s] > size}
            flagged = {int(p["paragraph"]) - int(np.searchsorted(layout.row_of, i)) for p in parts if p["kind"] and p["fresh"] == layout.paragraphs[p["paragraph"]]}
            assert flagged == cut_in


def test_pieces_by_tokens():
    rng = random.Random(6)
    words = [*WORDS[:-1], "Tokenization", "isn't", "2024", "naïve", "👩‍🔬", "—", "  ", "don't."]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", " ", "🎉" * 40, "\U00012031" * 9]
    v = vocabulary(path_of("byte_bpe_50k"))

    def ids(text):
        w, _ = v.words_of(pa.array([text]))
        return [i for x in w for i in v.flat[v.at[x] : v.at[x] + v.count[x]].tolist()]

    points, offsets, at_byte = code_points(pa.array(texts))
    layout, sizes = Layout(points, offsets), Sizes.of(pa.array(texts), at_byte, "byte_bpe_50k", FOLDER)
    whole = [ids(t) for t in texts]
    for size, overlap in ((20, 6), (20, 0), (4, 1), (300, 40)):
        c = cut(layout, sizes, size, overlap)
        seen = [set() for _ in texts]
        last = {}
        for k in range(len(c["row"])):
            row, start, fresh, stop = (int(c[n][k]) for n in ("row", "start", "fresh", "stop"))
            base = int(offsets[row])
            text = texts[row][start - base : stop - base]
            n = int(sizes.between(np.array([start]), np.array([stop]))[0])
            assert n <= size or stop == fresh + 1  # one character of more tokens than the size
            first = int(sizes.sums[start] - sizes.sums[base])
            edge = lambda x: x in (0, len(texts[row])) or texts[row][x - 1].isspace() or texts[row][x].isspace()  # noqa: B023, E731
            if edge(start - base) and edge(stop - base):
                assert ids(text) == whole[row][first : first + n]
            if row in last and start < last[row]:
                assert int(sizes.sums[last[row]] - sizes.sums[start]) <= overlap
            last[row] = stop
            seen[row] |= set(range(start - base, stop - base))
        assert all(seen[i] >= {k for k, ch in enumerate(t) if not ch.isspace()} for i, t in enumerate(texts))


def test_rows(spark):
    df = spark.createDataFrame([(1, "aa bb\n\ncc dd", "x"), (2, None, None), (3, " \n", None), (4, "z" * 100_000, None), (1, "aa bb\n\ncc dd", "x")], "k long, t string, text string")
    rows = split(df, "k", "t", [(7, 6, 2), (8, 50, None)]).collect()
    got = sorted((r.config_id, r.k, r.piece_no, r.text, r.cut) for r in rows if r.k == 1)
    assert got == sorted(2 * [(7, 1, 0, "aa bb", "paragraph"), (7, 1, 1, "cc dd", "paragraph"), (8, 1, 0, "aa bb\n\ncc dd", "paragraph")])
    long = sorted((r.piece_no, r.start, r.repeated, r.length) for r in rows if r.k == 4 and r.config_id == 7)
    assert long[:2] == [(0, 0, 0, 6), (1, 4, 2, 6)] and {r.k for r in rows} == {1, 4}
    assert split(df.limit(0), "k", "t", [(7, 6, 2)]).collect() == []
    for bad in ((1, 0, 0), (1, 5, 5), (1, 5, -1)):
        with pytest.raises(ValueError):
            split(df, "k", "t", [bad])
