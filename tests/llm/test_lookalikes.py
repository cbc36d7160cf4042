"""Consistent forms: against the standard library, and the cases that must and mustn't be equal."""

import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigraph.llm.arrays import code_points, to_text
from verdigraph.llm.lookalikes import forms, lookalike_pairs, visible_form


def form(texts):
    return to_text(*forms(*code_points(pa.array(texts, pa.string()))[:2])).to_pylist()


SAME = [
    ("Flat prοоf of Zoklefе", "Flat proof of Zoklefe"), ("a\xa0b", "a b"), ("a b", "a　b"), ("Vageth‑hidden", "Vageth-hidden"), ("a‐b", "a－b"),
    ("Esqu‍e​ma Laket\xadh", "Esquema Laketh"), ("oﬄine ﬁle", "offline file"), ("Ångström", "Ångström"), ("Å", "Å"), ("Ω", "Ω"),
    ("µ", "μ"), ("Ｆｉｌｔｒｏ", "Filtro"), ("о́", "ó"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("각", "각"), ("﻿x⁠", "x"), ("Кһ", "Kh"),
]
APART = [("l", "I"), ("0", "O"), ("x²", "x2"), ("x₂", "x2"), ("a  b", "a b"), ("a\tb", "a b"), ("é", "e"), ("A", "a"), ("λ-term", "A-term"), ("…", "..."), ("a–b", "a-b"), ("a.", "a"), ("a\xa0\xa0b", "a b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert len(set(form([a, b]))) == 1


@pytest.mark.parametrize(("a", "b"), APART)
def test_apart(a, b):
    assert len(set(form([a, b]))) == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"abcdeozAÉéèñçÅǻṩỗ", "́", "̈", "̣", "̇", "̧", "̸", "각", "ᄀ", "ᅡ", "ᆨ", "あ", "が"]), max_size=8), max_size=6))
def test_like_the_library(texts):
    assert form(texts) == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=5))
def test_stable_and_apart_by_row(texts):
    once = form(texts)
    assert form(once) == once and [form([t])[0] for t in texts] == once


def test_pairs(spark):
    rows = [(1, "ab", 0), (1, "аb", 0), (1, "a​b", 0), (2, "ab", 0), (None, "x", 0), (1, None, 0), (1, "", 0), (1, "​", 0), (1, "é" * 9000, 0), (1, "é" * 9000, 0)]
    df = spark.createDataFrame(rows, "g long, name string, form int")
    got = {(r.g, r.name_a, r.name_b) for r in lookalike_pairs(df, ["g"], "name").collect()}
    assert got == {(1, "ab", "аb"), (1, "ab", "a​b"), (1, "a​b", "аb"), (1, "", "​"), (1, "é" * 9000, "é" * 9000)}
    assert lookalike_pairs(df.limit(0), ["g"], "name").collect() == []
    kept = visible_form(df, "name").collect()
    assert len(kept) == len(rows) and {r.form for r in kept if r.name is None} == {None}
