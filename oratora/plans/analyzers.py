"""The nine analyzers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import counts, embeddings, network, records, temporal, texts, views
from .registry import Analyzer, analyzer


class _Base(Analyzer):
    def pick(self, table: dict) -> dict[str, DataFrame]:
        """Tables of the enabled features; ``table`` has feature -> {metric: function}."""
        return {k: f() for feature, metrics in table.items() if self.is_enabled(feature) for k, f in metrics.items()}


@analyzer("identity")
class Identity(_Base):
    default_features = ("thematic_fingerprint", "generalism_index", "distinctive_keywords")
    dependencies = ("embeddings", "labels", "centroids")

    def compute(self):
        if gone := self.missing():
            raise ValueError(f"identity needs {', '.join(gone)}")
        i, c = self.inputs, self.inputs.cols
        return self.pick({
            "thematic_fingerprint": {"fingerprint_speaker": lambda: embeddings.fingerprint(i.speeches, c.speaker, i.centroids, c), "fingerprint_party": lambda: embeddings.fingerprint(i.speeches, c.party, i.centroids, c)},
            "generalism_index": {"generalism_speaker": lambda: counts.generalism(i.speeches, c.speaker, c), "generalism_party": lambda: counts.generalism(i.speeches, c.party, c, skip_unknown=True)},
            "distinctive_keywords": {"party_keywords": lambda: texts.party_keywords(i.speeches, c, stopwords=i.lexicons.stopwords, blacklist=i.lexicons.blacklist)},
        })


@analyzer("sentiment")
class Sentiment(_Base):
    default_features = ("topic_sentiment", "readability", "polarization", "party_topic_sentiment", "sentiment_rankings")
    dependencies = ("labels",)

    def compute(self):
        f, c = self.inputs.features, self.inputs.cols
        return self.pick({
            "topic_sentiment": {"by_speaker": lambda: texts.sentiment_by(f, [c.speaker, c.topic], c), "by_party": lambda: texts.sentiment_by(f, [c.party, c.topic], c), "by_topic": lambda: texts.sentiment_by_topic(f, c)},
            "readability": {"readability_speaker": lambda: texts.readability_by(f, c.speaker, c), "readability_party": lambda: texts.readability_by(f, c.party, c), "readability_distribution": lambda: texts.readability_distribution(f)},
            "polarization": {"polarization_speaker": lambda: texts.polarization_by(f, c.speaker, c), "polarization_party": lambda: texts.polarization_by(f, c.party, c), "top_polarizers": lambda: texts.top_polarizers(f, c)},
            "party_topic_sentiment": {"party_topic_matrix": lambda: texts.party_topic_matrix(f, c)},
            "sentiment_rankings": {"sentiment_rankings": lambda: texts.sentiment_rankings(f, c)},
        })


@analyzer("temporal")
class Temporal(_Base):
    default_features = ("topic_trends", "semantic_drift", "crisis_index", "topic_surfing")
    dependencies = ("embeddings", "labels")

    def compute(self):
        i, f, c = self.inputs, self.inputs.features, self.inputs.cols
        g = self.options.get("granularity", "month")
        return self.pick({
            "topic_trends": {"trends": lambda: temporal.trends(i.speeches, c, g), "trends_party": lambda: temporal.trends(i.speeches, c, g, by_party=True)},
            "semantic_drift": {"drift": lambda: embeddings.drift(i.speeches, c), "drift_totals": lambda: embeddings.drift_totals(i.speeches, c)},
            "crisis_index": {"crisis": lambda: texts.crisis_by_period(f, c, g), "crisis_by_topic": lambda: texts.crisis_by_topic(f, c, g)},
            "topic_surfing": {"surfing": lambda: temporal.surfing(i.speeches, c), "surfing_timeline": lambda: temporal.surfing_timeline(i.speeches, c)},
        })


@analyzer("relations")
class Relations(_Base):
    default_features = ("affinity_matrix", "party_cohesion", "thematic_overlap", "cross_party_pairs")
    dependencies = ("embeddings", "labels")

    def compute(self):
        s, c = self.inputs.speeches, self.inputs.cols
        return self.pick({
            "affinity_matrix": {"affinity": lambda: embeddings.affinity(s, c), "affinity_matrix": lambda: embeddings.affinity_matrix(s, c)},
            "party_cohesion": {"cohesion": lambda: embeddings.cohesion(s, c)},
            "thematic_overlap": {"overlap": lambda: counts.overlap(s, c)},
            "cross_party_pairs": {"pairs": lambda: embeddings.with_sides(embeddings.cross_party_pairs(s, c))},
        })


@analyzer("speaker")
class Speaker(_Base):
    default_features = ("verbosity", "linguistic", "consistency", "topic_leadership", "intervention_patterns", "vocabulary", "network")
    optional_features = ("entity_focus",)
    dependencies = ("embeddings", "labels", "centroids")

    def compute(self):
        i, f, c = self.inputs, self.inputs.features, self.inputs.cols
        found = self.pick({
            "verbosity": {"verbosity": lambda: texts.verbosity(f, c)},
            "linguistic": {"linguistic": lambda: texts.linguistic(f, c)},
            "consistency": {"consistency": lambda: embeddings.consistency(i.speeches, c)},
            "topic_leadership": {"leadership": lambda: embeddings.topic_leadership(i.speeches, i.centroids, c), "leaders": lambda: embeddings.topic_leaders(i.speeches, i.centroids, c)},
            "intervention_patterns": {"interventions": lambda: temporal.interventions(i.speeches, c)},
            "vocabulary": {"vocabulary": lambda: texts.vocabulary(i.speeches, c)},
            "network": {"mentions": lambda: network.mention_network(i.speeches, c), "top_mentions": lambda: network.top_mentions(i.speeches, c)},
        })
        parts = [k for k in ("verbosity", "linguistic", "consistency", "leadership", "interventions", "vocabulary", "mentions") if k in found]
        if parts:
            found["speaker_record"] = records.speaker_record({k: found[k].drop(c.party) if k != "mentions" else found[k] for k in parts}, c)
        for name, source, score in (("most_verbose", "verbosity", "avg_words"), ("most_consistent", "consistency", "consistency"), ("most_active", "interventions", "avg_per_month"), ("richest_vocabulary", "vocabulary", "ttr")):
            if source in found:
                found[name] = views.ranked(found[source].select(c.speaker, score), score, c.speaker, 10)
        return found


@analyzer("rhetoric")
class Rhetoric(_Base):
    default_features = ("populist", "anti_establishment", "emotional", "institutional")

    def compute(self):
        f, c = self.inputs.features, self.inputs.cols
        on = tuple(k for k in self.default_features if self.is_enabled(k))
        if not on:
            return {}
        rankings = texts.rhetoric_rankings(f, c)
        return {"rhetoric_speaker": texts.rhetoric_by(f, c.speaker, c, features=on), "rhetoric_party": texts.rhetoric_by(f, c.party, c, features=on), "rhetoric_rankings": rankings.filter(rankings["kind"].isin(*on))}


@analyzer("factions")
class Factions(_Base):
    default_features = ("conformity", "faction_detection")
    dependencies = ("embeddings",)

    def compute(self):
        s, c = self.inputs.speeches, self.inputs.cols
        return self.pick({"conformity": {"conformity": lambda: embeddings.conformity(s, c)}, "faction_detection": {"factions": lambda: embeddings.factions(s, c)}})


@analyzer("alliances")
class Alliances(_Base):
    default_features = ("transversal_clusters", "unusual_pairs", "left_right_alliances")
    dependencies = ("embeddings",)

    def compute(self):
        s, c = self.inputs.speeches, self.inputs.cols
        return self.pick({
            "transversal_clusters": {"composition": lambda: counts.composition(s, c), "transversal": lambda: counts.transversal(s, c)},
            "unusual_pairs": {"unusual_pairs": lambda: embeddings.unusual_pairs(s, c)},
            "left_right_alliances": {"left_right": lambda: embeddings.left_right_alliances(s, c)},
        })


@analyzer("topics")
class Topics(_Base):
    def compute(self):
        i, c = self.inputs, self.inputs.cols
        words = texts.topic_keywords(i.speeches, c, self.options.get("top_n_keywords", 5), stopwords=i.lexicons.stopwords)
        return {"topic_keywords": words, "topic_labels": texts.topic_labels(words, c)}
