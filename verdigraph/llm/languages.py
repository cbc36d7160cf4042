"""Languages of documents and of their passages.

Method: a text is a bag of hashed subwords (character sequences of two to four letters with word ends, and the word
itself); their embeddings are averaged and a linear softmax gives the languages. Embeddings and softmax are trained by
stochastic gradient descent in numpy on labelled samples, on the driver, once per model.

Rejection: a sentence has no language if its confidence is below a limit, or if too few of its words and four-letter
sequences were ever met in the language it would have. The temperature and the first limit are set on sentences held out;
the second by leaving out each language in turn: how much of its sentences the others would know, against how much of a
sentence its own language knows from its other sentences.

Averages of embeddings under a linear layer are averages of each word's own scores, so a worker scores each distinct word
once; a sentence's scores are sums over its words. Texts are cut into lines and sentences on arrays.

A sentence ends with a stop (characters may stick to it) and has at least ``LEAST`` words (of scripts without blanks, letters); headings (``#``), tables (``|``), fenced code and runs of
characters without words are none. Passages are runs of sentences of one language; sentences without one join the run.

Defined cases: null, empty and blank texts, and texts without a sentence, have no language; texts are taken whole; a null
label names no language; ties between languages go to the one of the larger summed confidence, then to the code first in
order; repeated rows have equal results.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm.arrays import code_points, pieces

#: Samples to train on at most, and labelled documents, of each language: the bound of what is collected.
MOST_SAMPLES = 2_000
MOST_LABELLED = 60
#: Characters of a labelled document to be trained on; longer ones are identified like all, but not picked.
MOST_CHARS = 20_000
BUCKETS = 1 << 15
WIDTH = 16
#: Buckets of what was met in a language.
MET = 1 << 18
#: Words a sentence has at least, and sentences a language of several.
LEAST, ENOUGH = 3, 3
KEPT = 500_000
_STOPS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)

# Three-letter codes in use besides those of ISO 639-2/T, and another English name.
OTHER_CODES = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "castilian": "es", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el",
    "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}


def _plain(word: str) -> str:
    """In lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.strip().casefold()) if unicodedata.category(c) != "Mn")


def label_table(spark: SparkSession, codes: Iterable[str] = ()) -> dict[str, str]:
    """Two-letter codes by what labels say: the JVM's tables of codes and names, in English and in the language itself, and ``codes``."""
    out = dict(OTHER_CODES)
    if jvm := getattr(spark, "_jvm", None):
        locale = jvm.java.util.Locale
        for code in locale.getISOLanguages():
            one = locale.forLanguageTag(code)
            for name in (one.getDisplayLanguage(one), one.getDisplayLanguage(locale.ENGLISH), one.getISO3Language(), code):
                out[_plain(name)] = code
    return out | {_plain(c): c for c in codes}


def label_code(label: str | None, table: dict[str, str]) -> str | None:
    """The code that a label in any usual spelling means (en, EN, eng, English, en-US, en_GB.UTF-8, English (US), Français), None for none."""
    word = _plain(label or "")
    return table.get(word) or table.get(re.split(r"[-_.@(,;/]", word)[0].strip())


# Blocks of Thai to Lao, Myanmar, Khmer, Kana, and Han letters.
_NO_BLANKS = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters or marks, which white space, each one's lower case, and which letters have no blanks between words."""
    letter, space = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x32400):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        letter[c] = kind in "LM"
        space[c] = x.isspace()
        if len(small := x.lower()) == 1:
            lower[c] = ord(small)
    alone = np.zeros(0x110000, bool)
    for a, b in _NO_BLANKS:
        alone[a : b + 1] = letter[a : b + 1]
    return letter, space, lower, alone


def subwords(word: str) -> list[int]:
    """Hashes of the subwords of a word in lower case; the last ones, from four letters on, are the telling ones."""
    whole = f"<{word}>"
    parts = [whole[i : i + n] for n in (2, 3, 4) for i in range(len(whole) - n + 1)]
    return [zlib.crc32(p.encode("utf-8")) for p in (*parts, f"={word}")]


def telling(word: str) -> int:
    """How many of the subwords of a word are telling."""
    return max(0, len(word) - 1) + 1


@dataclass
class Model:
    codes: list[str]
    scores: np.ndarray  # of each subword hash, per language
    bias: np.ndarray
    met: np.ndarray  # whether a telling subword's hash was met in each language
    limit: float = 0.0
    least_met: float = 0.0
    #: Measured in training: sentences of samples held out that are right; of known sentences kept, of left-out languages' rejected.
    figures: dict[str, float] = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    word_met: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of ``word_scores`` (summed scores, number of subwords) and ``word_met`` (telling ones met, and their number)."""
        if len(self.known) > KEPT:
            self.known.clear()
        if not self.known:
            self.word_scores = self.word_met = np.zeros((0, len(self.codes) + 1), np.float32)
        if new := sorted(set(words).difference(self.known)):
            bags = [np.array(subwords(w)) for w in new]
            tells = [b[-telling(w) :] for w, b in zip(new, bags)]
            base = len(self.known)
            self.known.update({w: base + k for k, w in enumerate(new)})
            self.word_scores = np.concatenate((self.word_scores, self._sums(self.scores, bags)))
            self.word_met = np.concatenate((self.word_met, self._sums(self.met, tells)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _sums(table: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        size = np.array([*map(len, parts)])
        sums = np.add.reduceat(table[np.concatenate(parts) % len(table)], np.cumsum(size) - size, axis=0, dtype=np.float32)
        return np.column_stack((sums, size.astype(np.float32)))

    def judge(self, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Language (-1: none) and confidence of n sentences; each has words, as rows with their sentence."""
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.searchsorted(owner, np.arange(n))
        sums = np.add.reduceat(self.word_scores[rows], first, axis=0, dtype=np.float64)
        p = softmax(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias)
        best = p.argmax(axis=1)
        confidence = p[np.arange(n), best]
        met = np.add.reduceat(self.word_met[rows, best[owner]], first, dtype=np.float64)
        share = met / np.maximum(np.add.reduceat(self.word_met[rows, -1], first, dtype=np.float64), 1)
        return np.where((confidence >= self.limit) & (share >= self.least_met), best, -1), confidence


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True)) if logits.size else logits
    return e / e.sum(axis=-1, keepdims=True) if logits.size else logits


Bag = tuple[int, list[np.ndarray]]


def train(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = (), epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model:
    """A model from (language, text) samples, made broader by ``labelled`` documents, whose labels may be wrong.

    Of these, texts count whose label is the language that the first model finds most in them, with their sentences
    except those that it surely finds to be of another. A tenth of all sentences is held out for calibration.
    """
    codes = sorted({lang for lang, _ in samples})
    parts: dict[str, np.ndarray] = {}
    bags: list[Bag] = []
    said: list[tuple[int, list[str]]] = []
    s = Sentences(pa.array([t for _, t in samples], pa.string()), need_stop=False)
    for row, words in zip(s.row, _by_sentence(s)):
        if words:
            said.append((codes.index(samples[row][0]), words))
            bags.append((said[-1][0], [_subwords(w, parts) for w in words]))
    n_samples = len(bags)
    fit = _start(len(codes), seed)
    _descend(fit, [b for k, b in enumerate(bags) if k % 10], epochs, rate, seed)
    if labelled := [(lang, text) for lang, text in labelled if lang in codes]:
        first = Model(codes, fit[0] @ fit[1], fit[2].copy(), np.zeros((1, len(codes)), np.uint8))
        s, lang, confidence = judged(pa.array([t for _, t in labelled], pa.string()), first)
        own = np.array([codes.index(c) for c, _ in labelled])
        count = np.bincount(s.row * len(codes) + lang, minlength=len(labelled) * len(codes)).reshape(-1, len(codes))
        sound = (count.argmax(axis=1) == own) & (count.max(axis=1) >= ENOUGH)
        more = [(int(own[row]), words) for row, words, l, c in zip(s.row, _by_sentence(s), lang, confidence) if sound[row] and words and (l == own[row] or c < 0.95)]
        said += more
        bags += [(lang, [_subwords(w, parts) for w in words]) for lang, words in more]
        _descend(fit, [b for k, b in enumerate(bags) if k % 10], 2, rate / 4, seed + 1)
    held = bags[::10]
    logits = np.array([fit[0][np.concatenate(words)].mean(axis=0) @ fit[1] + fit[2] for _, words in held]).reshape(-1, len(codes))
    truth = np.array([lang for lang, _ in held], np.int64)
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(losses, key=losses.get)
    p = softmax(logits / temperature)
    right = p.argmax(axis=1) == truth
    limit = float(np.quantile(p.max(axis=1)[right], 0.001) * 0.8) if right.any() else 0.0
    met, least, kept, refused = _met(said, len(codes))
    figures = {"right": float(right[: -(-n_samples // 10)].mean()) if n_samples else 0.0, "kept": kept, "rejected": refused}
    return Model(codes, fit[0] @ fit[1] / temperature, fit[2] / temperature, met, limit, least, figures)


def _met(said: list[tuple[int, list[str]]], n: int) -> tuple[np.ndarray, float, float, float]:
    """What was met in each language; the least share of it that a sentence needs; sentences kept and rejected by that.

    A sentence is known by its own language's other sentences; that of a language left out, by the best of the others. The
    least share rejects 19 of 20 of the latter, unless that would reject more than one in a thousand of the former.
    """
    count = np.zeros((MET, n), np.int32)
    known: dict[str, np.ndarray] = {}

    def bag(words: list[str]) -> np.ndarray:
        for w in words:
            if w not in known:
                known[w] = np.array(subwords(w)[-telling(w) :]) % MET
        return np.concatenate([known[w] for w in words])

    bags = [(lang, bag(words)) for lang, words in said]
    for lang, b in bags:
        count[np.unique(b), lang] += 1
    own = np.array([(count[b, lang] > 1).mean() for lang, b in bags])
    met = (count > 0).astype(np.uint8)
    if n > 1:
        others = np.array([np.delete(met[b].mean(axis=0), lang).max() for lang, b in bags])
        least = float(min(np.quantile(others, 0.95), np.quantile(own, 0.001))) if bags else 0.0
        return met, least, float((own >= least).mean()) if bags else 1.0, float((others < least).mean()) if bags else 0.0
    return met, 0.0, 1.0, 0.0


def _subwords(word: str, known: dict[str, np.ndarray]) -> np.ndarray:
    if word not in known:
        known[word] = np.array(subwords(word), np.int64) % BUCKETS
    return known[word]


def _by_sentence(s: Sentences) -> list[list[str]]:
    words, owner = s.words()
    ends = np.searchsorted(owner, np.arange(len(s.start)), "right").tolist()
    return [words[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _start(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (WIDTH, n)), np.zeros(n)


def _descend(fit: tuple[np.ndarray, np.ndarray, np.ndarray], bags: list[Bag], epochs: int, rate: float, seed: int) -> None:
    rng = np.random.default_rng(seed)
    embed, weight, bias = fit
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(bags)):
            lang, words = bags[k]
            if len(words) > 4:  # another part of the sentence each time
                words = [w for w, keep in zip(words, rng.random(len(words)) < 0.7) if keep] or words
            f = np.concatenate(words)
            h = embed[f].mean(axis=0)
            g = softmax(h @ weight + bias)
            g[lang] -= 1
            back = weight @ g
            weight -= step * np.outer(h, g)
            bias -= step * 0.1 * g
            np.subtract.at(embed, f, step * back / len(f) * 4)


class Sentences:
    """The sentences of a batch: start and end in code points, and row."""

    def __init__(self, text: pa.Array, need_stop: bool = True) -> None:
        points, offsets, _ = code_points(text)
        self.points, self.offsets = points, offsets
        n = len(points)
        self.start = self.end = self.row = np.zeros(0, np.int64)
        if not n:
            return
        letter, space, _, alone = _tables()
        is_letter, is_space = letter[points], space[points]
        # Lines.
        line_end = (points == 10) | ((points == 13) & (np.append(points[1:], 0) != 10))
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[:n]
        begins = first.copy()
        begins[1:] |= line_end[:-1]
        line_at = np.flatnonzero(begins)
        seen = np.flatnonzero(~is_space)
        head = np.searchsorted(seen, line_at)
        line_stop = np.append(line_at[1:], n)
        at = seen[np.minimum(head, len(seen) - 1)] if len(seen) else np.full(len(line_at), n)
        real = (at < line_stop) & (at >= line_at)
        mark = np.where(real, points[np.minimum(at, n - 1)], 0)
        later = lambda k: np.where(real & (at + k < line_stop), points[np.minimum(at + k, n - 1)], 0)
        fence = ((mark == 96) & (later(1) == 96) & (later(2) == 96)) | ((mark == 126) & (later(1) == 126) & (later(2) == 126))
        line_row = np.searchsorted(offsets, line_at, "right") - 1
        fences = np.cumsum(fence)
        row_first = np.searchsorted(line_row, np.arange(len(offsets) - 1))
        before = np.concatenate(([0], fences))[row_first]
        inside = (fences - before[line_row]) % 2 == 1
        prose = real & ~fence & ~inside & (mark != 35) & (mark != 124)
        # Segments: from a stop, or the beginning of a line, to the next stop, or the end of the line.
        stop = np.isin(points, _STOPS)
        after = np.append(points[1:], 32)
        wordish = ((after >= 48) & (after <= 57)) | ((after >= 65) & (after <= 90)) | ((after >= 97) & (after <= 122))
        digit = (points >= 48) & (points <= 57)
        number = np.append(False, digit[:-1]) & np.append(digit[1:], False)
        tight = np.flatnonzero(stop & wordish & ~number)  # before characters stuck to a sentence's end; not in 3.5
        stop &= ~wordish | np.append(begins[1:], True)
        cut = begins.copy()
        cut[1:] |= stop[:-1]
        seg_at = np.flatnonzero(cut)
        seg_end = np.append(seg_at[1:], n)
        line_of = np.searchsorted(line_at, seg_at, "right") - 1
        stopped = stop[seg_end - 1]
        token = np.cumsum(np.append(True, is_space[:-1]) & ~is_space)
        letters = np.flatnonzero(is_letter)
        fresh = np.append(True, token[letters[1:]] != token[letters[:-1]])[: len(letters)] | alone[points[letters]]
        count = np.zeros(n + 1, np.int64)
        count[1:][letters[fresh]] = 1
        count = np.cumsum(count)
        # A segment without a stop at its end has it at the last one that something sticks to.
        if len(tight):
            at = tight[np.maximum(np.searchsorted(tight, seg_end) - 1, 0)]
            late = ~stopped & (at >= seg_at) & (at < seg_end)
            seg_end, stopped = np.where(late, at + 1, seg_end), stopped | late
        good = prose[line_of] & (count[seg_end] - count[seg_at] >= LEAST)
        if need_stop:
            good &= stopped
        self.start, self.end = seg_at[good], seg_end[good]
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    def words(self) -> tuple[list[str], np.ndarray]:
        """The words of all sentences, in lower case, and the sentence of each."""
        if not len(self.start):
            return [], np.zeros(0, np.int64)
        letter, _, lower, _ = _tables()
        is_letter = letter[self.points]
        starts = np.flatnonzero(is_letter & ~np.append(False, is_letter[:-1]))
        ends = np.flatnonzero(is_letter & ~np.append(is_letter[1:], False)) + 1
        owner = np.searchsorted(self.start, starts, "right") - 1
        keep = (owner >= 0) & (starts < self.end[np.maximum(owner, 0)])
        starts, ends, owner = starts[keep], ends[keep], owner[keep]
        ends = np.minimum(ends, self.end[owner])
        small = lower[self.points].tobytes().decode("utf-32-le")
        return [small[i:j] for i, j in zip(starts.tolist(), ends.tolist())], owner


def judged(text: pa.Array, model: Model) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """Sentences of a batch with language (-1: none) and confidence."""
    s = Sentences(text)
    words, owner = s.words()
    return s, *model.judge(model.words(words), owner, len(s.start))


SCHEMAS = {
    "cases": "lang string",
    "documents": "lang string, label string, confidence double, n_sentences int, share double, is_case boolean",
    "passages": "passage_no int, start long, length long, n_sentences int, lang string, confidence double",
}


def fitted(docs: DataFrame, samples: DataFrame) -> Model:
    """A model for documents (key, text, label); what is collected for it is bounded."""
    own = samples.filter("lang is not null and text is not null").select("lang", "text")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    rows = own.withColumn("n", nth).filter(F.col("n") <= MOST_SAMPLES).orderBy("lang", "n").collect()
    codes = sorted({r.lang for r in rows})
    # The keys are picked without their texts, then looked up.
    first = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("key"), "key"))
    picked = docs.filter(F.col("label").isin(codes)).select("key", "label").withColumn("n", first).filter(F.col("n") <= MOST_LABELLED).select("key", "label", "n").collect()
    order = {r.key: (r.label, r.n) for r in picked}
    texts = docs.filter(F.col("key").isin([*order])).filter(F.char_length("text") <= MOST_CHARS).select("key", "label", "text").collect() if order else []
    texts = sorted({r.key: r for r in texts}.values(), key=lambda r: order[r.key])
    return train([(r.lang, r.text) for r in rows], [(r.label, r.text) for r in texts])


def identify(df: DataFrame, key: str, column: str, label: str, samples: DataFrame, emit: str = "documents") -> DataFrame:
    """Languages of texts.

    documents: a row per document and language (null: no sentence), with whether its label is missing or wrong or the text
    has several languages. cases: the languages of such documents only. passages: runs of sentences of one language.
    ``samples`` has lang and text; at most ``MOST_SAMPLES`` rows of each language are used, picked by a hash, and
    ``MOST_LABELLED`` texts of each language that a label names by its code, picked by a hash of the key, of which those
    above ``MOST_CHARS`` characters are left out.
    """
    docs = df.select(F.col(key).alias("key"), F.col(column).alias("text"), F.col(label).alias("label"))
    model = fitted(docs, samples)
    table = label_table(df.sparkSession, model.codes)
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), *T._parse_datatype_string(SCHEMAS[emit]).fields])
    names = [f.name for f in schema]
    n = len(model.codes)
    values = pa.array([*model.codes, None], pa.string())
    numbers = {c: k for k, c in enumerate(model.codes)}
    fixed = (model.codes, model.scores.astype(np.float32), model.bias, model.met, model.limit, model.least_met)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*fixed)
        for batch in pieces(batches, "text", 2_000_000):
            s, lang, confidence = judged(batch.column("text"), own)
            m = batch.num_rows
            if emit == "passages":
                yield _passages(s, lang, confidence, batch.column("key"), values, names)
                continue
            known = lang >= 0
            at = s.row[known] * n + lang[known]
            count = np.bincount(at, minlength=m * n).reshape(m, n)
            total = np.bincount(at, weights=confidence[known], minlength=m * n).reshape(m, n)
            most = np.lexsort((np.broadcast_to(-np.arange(n), (m, n)), total, count), axis=1)[:, -1] if m else np.zeros(0, np.int64)
            is_lang = count >= ENOUGH
            none = ~is_lang.any(axis=1) & (count.sum(axis=1) > 0)
            is_lang[none, most[none]] = True
            label = batch.column("label").dictionary_encode()
            code = np.array([*(numbers.get(label_code(x, table) or "", -1) for x in label.dictionary.to_pylist()), -1], np.int64)
            named = code[label.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)]
            several = is_lang.sum(axis=1)
            case = (several > 0) & ~((several == 1) & (named >= 0) & is_lang[np.arange(m), np.maximum(named, 0)])
            if emit == "cases":
                row, which = np.nonzero(is_lang & case[:, None])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), values.take(pa.array(which))], names)
                continue
            is_lang = np.column_stack((is_lang, several == 0))  # a row too for those without language
            row, which = np.nonzero(is_lang)
            pad = lambda x: np.column_stack((x, np.zeros(m, x.dtype)))[row, which]
            k = pad(count)
            mean = np.divide(pad(total), k, out=np.zeros(len(k)), where=k > 0)
            share = np.divide(k, count.sum(axis=1)[row], out=np.zeros(len(k)), where=k > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), values.take(pa.array(which)), batch.column("label").take(pa.array(row)), pa.array(mean), pa.array(k.astype(np.int32)), pa.array(share), pa.array(case[row])],
                names,
            )

    return docs.mapInArrow(run, schema)


def _passages(s: Sentences, lang: np.ndarray, confidence: np.ndarray, keys: pa.Array, codes: pa.Array, names: list[str]) -> pa.RecordBatch:
    row = s.row
    if len(row):
        # A sentence without language has that of the one before it in its text, else of the next.
        new_row = np.append(True, row[1:] != row[:-1])
        for step in (1, -1):
            l, r = lang[::step], row[::step]
            last = np.maximum.accumulate(np.where(l >= 0, np.arange(len(l)), -1))
            lang = np.where((l < 0) & (last >= 0) & (r[np.maximum(last, 0)] == r), l[np.maximum(last, 0)], l)[::step]
        first = np.flatnonzero(new_row | np.append(True, lang[1:] != lang[:-1]))
    else:
        first = np.zeros(0, np.int64)
    end = np.append(first[1:], len(row))[: len(first)]
    of = row[first]
    opens = np.append(True, of[1:] != of[:-1])[: len(first)]
    number = np.arange(len(first)) - np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0)) if len(first) else first
    sums = np.add.reduceat(confidence, first) if len(first) else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(of)),
            pa.array(number.astype(np.int32)),
            pa.array(s.start[first] - s.offsets[of]),
            pa.array(s.end[end - 1] - s.start[first]),
            pa.array((end - first).astype(np.int32)),
            codes.take(pa.array(np.where(lang[first] < 0, len(codes) - 1, lang[first]))),
            pa.array(sums / np.maximum(end - first, 1)),
        ],
        names,
    )
