from verdigraph.plans import catalog
from verdigraph.streaming.triples import drained, once_each, windowed


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:20:00"), (3, "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "cast(t as timestamp) t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in drained(once_each(stream(), "k", "t", "1 hour")).collect()) == [1, 2, 3]
    assert [(r.n) for r in drained(windowed(stream(), "t", "1 minute", "1 hour")).collect()] == [3]


def test_redelivered_triples_count_once(spark, tmp_path):
    rows = [(1, "is_a", "2024-01-01"), (2, "is_a", "2024-01-01"), (1, "is_a", "2024-01-01"), (3, "is_a", "2024-06-01"), (1, "is_a", "2024-01-01")]
    df = spark.createDataFrame(rows, "triple_id long, relation string, t string").selectExpr("triple_id", "relation", "cast(t as timestamp) loaded_at")
    df.repartition(3).write.parquet(str(tmp_path / "triples.parquet"))
    got = {q: sorted(r.n for r in catalog.queries()[q](spark, str(tmp_path)).collect()) for q in ("stream_triples", "stream_triples_once")}
    assert got == {"stream_triples": [1, 4], "stream_triples_once": [1, 2]}
