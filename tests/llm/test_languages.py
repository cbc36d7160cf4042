"""Languages: held-out accuracy, what is no sentence, what makes a case."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracles import DATA

from pyspark.sql import functions as F

from verdigraph.llm import languages
from verdigraph.llm.languages import Sentences, fitted, identify, judged, label_code, label_table, train

MEMORY = {"en": "Nobody has to learn this by heart.", "de": "Niemand muss das auswendig lernen.", "es": "Nadie tiene que aprender esto de memoria."}


@pytest.fixture(scope="module")
def samples():
    return pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()


def test_held_out(samples):
    rows = [(r["lang"], r["text"]) for r in samples]
    model = train([r for k, r in enumerate(rows) if k % 4])
    held = [r for k, r in enumerate(rows) if not k % 4]
    s, lang, _ = judged(pa.array([t for _, t in held]), model)
    right = [l >= 0 and model.codes[l] == held[row][0] for l, row in zip(lang, s.row)]
    assert len(right) > 60 and sum(right) / len(right) > 0.9


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("One two three. Four five six! Seven eight nine?", 3), ("# A heading of words.\n", 0), ("| a b c d. |", 0), ("```\nthis is some code.\n```\nBut this is none.", 1),
        ("no stop at the end", 0), ("Too short.", 0), ("kavusk_samesk_gileklum_parul.", 0), ("It costs 3.5 in this shop.", 1), ("- A point of a list.\r\n> A word of others.", 2),
        ("", 0), (" \n ", 0), ("One two three.😀", 1), ("One two three.xxxxx", 1), ("One two three.ááá x\nNo stop in v3.5 either way", 1), ("One two v3.5", 0), ("**Term**: It means a thing.", 1),
    ],
)
def test_sentences(text, n):
    assert len(Sentences(pa.array([text])).start) == n


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN", "en"), ("en_US", "en"), ("pt-BR", "pt"), ("deu", "de"), ("ger", "de"), (" Spanish ", "es"), ("und", None), ("", None), (None, None), ("unknown", None), ("nl", "nl"), ("sl", "sl"), ("srp", "sr"), ("English (US)", "en"), ("Français", "fr"), ("francais", "fr"), ("Deutsch", "de"), ("en_GB.UTF-8", "en"), ("xx", "xx"), ("n/a", None)])
def test_labels(spark, label, code):
    assert label_code(label, label_table(spark, ["xx"])) == code


# Languages without samples.
UNSEEN = [
    "De meeste fouten komen door onzorgvuldig gebruik van de lijst.", "Voor het examen moet je de methode kunnen uitleggen.", "De flesta fel beror på att man använder listan utan att tänka efter.",
    "Ingen behöver lära sig detta utantill.", "Większość błędów wynika z nieuważnego użycia tej listy.", "Nikt nie musi uczyć się tego na pamięć.", "Більшість помилок виникає через необережне використання цього списку.",
    "Перед іспитом треба вміти пояснити цей метод.", "Hataların çoğu listenin dikkatsiz kullanılmasından kaynaklanır.", "Τα περισσότερα λάθη προέρχονται από την απρόσεκτη χρήση της λίστας.",
    "Useimmat virheet johtuvat listan huolimattomasta käytöstä.", "Kenenkään ei tarvitse opetella tätä ulkoa.", "Cele mai multe greșeli provin din folosirea neatentă a listei.", "Většina chyb vzniká nepozorným používáním tohoto seznamu.",
    "De fleste fejl skyldes uforsigtig brug af listen.", "Ingen behøver at lære dette udenad.", "La majoria dels errors provenen de fer servir la llista sense cura.", "多くの間違いはリストの不注意な使用から生じます。", "大多数错误来自对列表的粗心使用。", "ข้อผิดพลาดส่วนใหญ่มาจากการใช้รายการอย่างไม่ระวัง. ",
]


def test_rejection_and_the_full_model(spark, samples):
    rows = [(r["lang"], r["text"]) for r in samples]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    table = spark.createDataFrame([r for k, r in enumerate(rows) if k % 4], "lang string, text string")
    model = fitted(docs, table)
    held = [r for k, r in enumerate(rows) if not k % 4]
    s, lang, _ = judged(pa.array([t for _, t in held]), model)
    right = [l >= 0 and model.codes[l] == held[row][0] for l, row in zip(lang, s.row)]
    assert len(right) > 60 and sum(right) / len(right) > 0.97
    s, lang, _ = judged(pa.array(UNSEEN), model)
    assert len(lang) == len(UNSEEN) and sum(l < 0 for l in lang) / len(lang) >= 0.9
    assert model.figures["kept"] > 0.99


def test_samples_are_picked_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_SAMPLES", 3)
    rows = [(c, f"{c}a {c}b {c}c {i}.") for c in ("en", "zz") for i in range(9)] + [("en", None), (None, "x y z.")]
    model = fitted(spark.createDataFrame([], "key long, text string, label string"), spark.createDataFrame(rows, "lang string, text string"))
    assert model.codes == ["en", "zz"]


def test_cases(spark, samples):
    texts = {c: " ".join(r["text"] for r in samples if r["lang"] == c)[:3000] for c in ("en", "de", "es")}
    rows = [
        (1, texts["en"], "English", "x"), (2, texts["en"], None, None), (3, texts["en"], "de", None), (4, texts["en"] + "\n\n" + texts["de"], "en", None), (5, None, "en", None),
        (6, "", None, None), (7, "# Only a heading", "und", None), (8, MEMORY["es"], "fr", None), (9, texts["en"] + "\n" + MEMORY["de"], "EN", None), (1, texts["en"], "English", "x"),
    ]
    df = spark.createDataFrame(rows, "k long, t string, l string, lang string")
    table = spark.createDataFrame([(r["lang"], r["text"]) for r in samples], "lang string, text string")
    got = sorted((r.k, r.lang) for r in identify(df, "k", "t", "l", table, "cases").collect())
    assert got == [(2, "en"), (3, "en"), (4, "de"), (4, "en"), (8, "es")]
    docs = identify(df, "k", "t", "l", table, "documents").collect()
    assert sorted({r.k for r in docs if r.lang is None}) == [5, 6, 7] and all(r.confidence > 0.5 for r in docs if r.lang)
    passages = sorted((r.k, r.passage_no, r.lang) for r in identify(df, "k", "t", "l", table, "passages").collect() if r.k in (4, 9))
    assert passages == [(4, 0, "en"), (4, 1, "de"), (9, 0, "en"), (9, 1, "de")]
    assert identify(df.limit(0), "k", "t", "l", table).collect() == []
