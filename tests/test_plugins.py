"""Pluggable models, with trivial ones."""

from pyspark import cloudpickle

from oratora.operators import plugins

cloudpickle.register_pickle_by_value(plugins)


def test_plugins(spark):
    rows = [(i, "A", "Roma e Milano" if i % 2 else "Roma") for i in range(4)] + [(9, "B", None)]
    df = spark.createDataFrame(rows, "speech_id long, deputy string, cleaned_text string")
    assert {r.speech_id: list(r.embedding) for r in plugins.embed(df, lambda: lambda ts: [[float(len(t))] for t in ts]).collect()}[9] == [0.0]
    assert {r.sentiment for r in plugins.model_sentiment(df, lambda: lambda ts: [1.0 for _ in ts], size=2).collect()} == {1.0}
    got = plugins.entity_focus(df, lambda: lambda t: [(w, "GPE") for w in t.split() if w != "e"]).collect()
    assert [(r.deputy, r.kind, r.entity, r.n) for r in sorted(got, key=lambda r: r["rank"])] == [("A", "LOC", "Roma", 4), ("A", "LOC", "Milano", 2)]
    assert plugins.topic_texts({0: ("X", ["a", "b"]), 1: ("Y", [])}) == {0: "X: a, b", 1: "Y"}
