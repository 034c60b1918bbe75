"""Registry, orchestrator, cache, export, streams."""

import json
from datetime import datetime, timezone

import pytest

from oratora.operators import embeddings
from oratora.plans import cache, export, orchestrator, registry
from oratora.plans.registry import Inputs
from oratora.plans.retry import retry
from oratora.sources import stores
from oratora.sources.views import embedded, table
from oratora.streaming import trends


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    e = embedded(spark, sf_dir)
    return Inputs(e, embeddings=True, labels={0: "Zero"}, centroids=embeddings.topic_centroids(e))


def test_registry():
    assert set(registry.names()) == {"identity", "sentiment", "temporal", "relations", "speaker", "rhetoric", "factions", "alliances", "topics"}
    assert set(registry.by_dependency("centroids")) == {"identity", "speaker"}
    with pytest.raises(ValueError):
        registry.get("nothing")


def test_features_and_options(inputs):
    config = {"analyzers": {"rhetoric": {"features": {"populist": False, "unheard": True}}, "temporal": {"options": {"granularity": "week"}, "features": {"semantic_drift": False, "crisis_index": False, "topic_surfing": False}}}}
    o = orchestrator.Orchestrator(inputs, config)
    assert "populist" not in o.run("rhetoric")["rhetoric_speaker"].columns
    assert list(o.run("temporal")) == ["trends", "trends_party"]
    assert "-W" in o.run("temporal")["trends"].first().period


def test_failures_stay_apart(spark, inputs):
    config = {"analyzers": {n: {"enabled": n in ("rhetoric", "identity", "sentiment")} for n in registry.names()}}
    bare = Inputs(inputs.speeches.drop("cleaned_text"))
    got = orchestrator.Orchestrator(bare, config).run_all()
    assert "identity" not in got and "error" in got["sentiment"]


def test_every_analyzer_computes(inputs):
    for name in registry.names():
        tables = orchestrator.Orchestrator(inputs).run(name)
        assert tables and all(t.columns for t in tables.values()), name


def test_cache(spark, tmp_path):
    c = cache.ResultCache(str(tmp_path / "c"))
    df = spark.range(3)
    assert c.rows("r", df) == c.rows("r", df) and c.stats() == {"hits": 1, "misses": 1, "entries": 1}
    c.clear_memory()
    assert len(c.rows("r", df)) == 3 and c.hits == 2
    assert len(c.rows("r", spark.range(4))) == 4  # another plan is another entry
    assert c.invalidate("r*") == 2 and not c.has("*")
    assert cache.key_of("n", b=1, a=2) == cache.key_of("n", a=2, b=1)


def test_ages():
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    meta = cache.metadata("both", now=datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert cache.age_days(meta, now) == 30 and cache.is_valid(meta, 31, now) and not cache.is_valid(meta, 30, now)
    assert not cache.is_valid({}, 30)


def test_config(tmp_path):
    p = str(tmp_path / "c.json")
    orchestrator.save_config({"analyzers": {"topics": {"enabled": False}}}, p)
    c = orchestrator.load_config(p)
    assert not orchestrator.lookup(c, "analyzers.topics.enabled") and orchestrator.lookup(c, "analyzers.identity.enabled") and orchestrator.lookup(c, "no.such", 7) == 7


def test_document(spark, inputs, tmp_path):
    off = {"analyzers": {n: {"enabled": n == "factions"} for n in registry.names()}}
    doc = export.document(inputs.speeches, "camera", {"embeddings": True}, off)
    back = json.loads(open(export.write_document(doc, str(tmp_path)), encoding="utf-8").read())
    assert back["stats"]["n_speeches"] > 0 and set(back["analytics"]["factions"]) == {"conformity", "factions"}


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"text": "a", "deputy": "X"}, {"text": "b"}]))
    a = stores.read_json_speeches(spark, str(tmp_path / "s.json"), "camera")
    both = stores.union_sources({"camera": a, "senate": spark.createDataFrame([("c",)], "text string")})
    stores.write_speeches(both, str(tmp_path / "p"))
    assert sorted((r.text, r.source) for r in stores.read_speeches(spark, str(tmp_path / "p")).collect()) == [("a", "camera"), ("b", "camera"), ("c", "senate")]


def test_retry():
    calls = []

    @retry(3, 1.0, 2.0, sleep=calls.append)
    def fails():
        raise OSError("no")

    with pytest.raises(OSError):
        fails()
    assert calls == [1.0, 2.0]


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = trends.windowed_counts(trends.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), "event_type")
    q = stream.writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = trends.windowed_counts(events.withColumn("ts", events.ts.cast("timestamp")), "event_type")
    assert sorted(map(tuple, spark.table("t").collect())) == sorted(map(tuple, batch.collect()))
