"""Copies and groups against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verdigraph.llm import duplicates
from verdigraph.llm.duplicates import copies, records
from verdigraph.llm.groups import consolidate

ENTRIES = ["kind: Tool; Name X", "name x|KIND:tool", " NAME-X ;kind tool;", "name x", "Náme x", "na​me x", ";;", "", None, "…", "name x;name x", "name\tx\n", "a+b", "A+B.", "ÅB", "åb", "x" * 50_000, "X" * 50_000, "ΑΣ Β", "ΑΣΒ", "ας β", "ΟΔΟΣ", "οδοσ", "οδος", "straße", "STRASSE"]


def key(entry):
    import unicodedata

    fold = lambda f: "".join(c.casefold() if len(c.casefold()) == 1 else c.lower() for c in f)
    if entry is None:
        return ()
    fields = ["".join(c for c in fold(f) if unicodedata.category(c)[0] not in "ZP" and c not in "\t\n\x0b\f\r\x85") for f in entry.replace("|", ";").split(";")]
    return tuple(sorted(f for f in fields if f))


def test_copies(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(g, p, rng.choice(ENTRIES), "x") for g in (1, 2, None) for p in range(40)]
    rows += rows[:10]  # a row that comes twice is one entry
    df = spark.createDataFrame(rows, "g long, p int, e string, record string")
    groups = defaultdict(set)
    for g, p, e, _ in rows:
        if key(e):
            groups[g, key(e)].add(p)
    truth = {(g, min(ps), p) for (g, _), ps in groups.items() for p in ps if p > min(ps) and g is not None}
    for block in (65_536, 7):
        monkeypatch.setattr(duplicates, "BLOCK", block)
        got = [tuple(r) for r in copies(df.filter("g is not null"), ["g"], "e", "p").collect()]
        assert len(got) == len(set(got)) and set(got) == truth
    made = {(r.g, tuple(r.record)): (r.copies, r.first) for r in records(df, ["g"], "e", "p").collect()}
    assert made == {k: (len(ps), min(ps)) for k, ps in groups.items()}
    assert copies(df.limit(0), ["g"], "e", "p").collect() == []


def test_hot_record(spark):
    df = spark.range(30_000).selectExpr("1L g", "cast(id as int) p", "concat('Same', repeat('.', cast(id % 5000 as int))) e")
    assert copies(df, ["g"], "e", "p").count() == 29_999


def components(links):
    names = {x for link in links for x in link}
    group = {x: x for x in names}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


@pytest.mark.parametrize("bound", [10**6, 15])
@pytest.mark.parametrize("scope", [["g"], []])
def test_groups(spark, bound, scope):
    rng = random.Random(bound)
    rows = []
    for g in (1, 2, None):
        n = 60
        rows += [(g, f"é{rng.randrange(n)}", f"é{rng.randrange(n)}", "x") for _ in range(45)]
        rows += [(g, f"c{i:03d}", f"c{i + 1:03d}", "x") for i in range(30)]  # a long chain
        rows += [(g, "hub", f"s{i}", "x") for i in range(30)]
    rows += [(1, "a", None, None), (1, None, "b", None), (1, "self", "self", None), *rows[:5]]
    if not scope:
        rows = [r for r in rows if r[0] == 1]
    df = spark.createDataFrame(rows, "g long, a string, b string, name string").repartition(5)
    truth = {}
    for g in {r[0] for r in rows}:
        links = [(r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None]
        truth |= {((g,) if scope else ()) + (x,): y for x, y in components(links).items()}
    if bound < 100 and scope:
        df, truth = df.filter("g is not null"), {k: v for k, v in truth.items() if k[0] is not None}
    got = consolidate(df, scope, "a", "b", bound).collect()
    assert len(got) == len(truth) and {tuple(r)[:-1]: r.group for r in got} == truth


def test_more_names_than_links_held(spark):
    # Chains z -> y -> x whose links come in different partitions: 56 links are within the bound, their 84 names aren't.
    halves = [[(1, f"{end}{i:02d}", f"{start}{i:02d}") for i in range(28)] for end, start in ("zy", "yx")]
    df = [spark.createDataFrame(rows, "g long, a string, b string").coalesce(1) for rows in halves]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "5")
    try:
        got = consolidate(df[0].unionByName(df[1]), ["g"], "a", "b", bound=60, piece=5).collect()
    finally:
        spark.conf.unset(batch)
    assert sorted((r.name, r.group) for r in got) == sorted((f"{c}{i:02d}", f"x{i:02d}") for c in "xyz" for i in range(28))


@pytest.mark.parametrize("kind", ["star", "chain"])
def test_large_scope_is_spread(spark, kind):
    n, bound = 10_000, 1_000
    other = F.lit("a hub") if kind == "star" else F.format_string("n%05d", F.col("id") + 1)
    df = spark.range(n).select(F.lit(1).alias("g"), F.format_string("n%05d", "id").alias("x"), other.alias("y"))
    got = consolidate(df.repartition(8), ["g"], "x", "y", bound).collect()
    assert len(got) == n + 1 and {r.group for r in got} == {"a hub" if kind == "star" else "n00000"}
    parts = df.repartition(10, "g", "x", "y").groupBy(F.spark_partition_id().alias("p")).count()
    assert max(r["count"] for r in parts.collect()) < 2 * n / 10


def test_no_pairs(spark):
    df = spark.createDataFrame([], "g long, a string, b string")
    assert consolidate(df, ["g"], "a", "b").collect() == []
