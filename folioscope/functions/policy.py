"""Corpus policy: which works come in, and why others don't, as one ordered CASE chain."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Gates of a corpus. ``sources`` maps a source slug to its class, core or edge."""

    min_year: int = 1996
    language: str = "en"
    types: tuple[str, ...] = ("article", "conference-paper")
    exclusion_terms: tuple[str, ...] = ()
    strong_terms: tuple[str, ...] = ()
    edge_terms: tuple[str, ...] = ()
    sources: dict[str, str] = field(default_factory=dict)


def blob(*columns: str) -> Column:
    """One lower-cased text to look for terms in."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def matched(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms that stand in the text, in their own order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(text, t))


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return F.size(matched(text, terms)) > 0


def decide(p: Policy, text: Column, year: Column, language: Column, kind: Column, retracted: Column, abstract: Column, source: Column, curated: Column, connected: Column) -> Column:
    """struct(included, reason, venue_class, matched): the first gate that a work fails names the reason."""
    classes = F.create_map(*[F.lit(x) for pair in p.sources.items() for x in pair]) if p.sources else F.create_map().cast("map<string,string>")
    venue = F.try_element_at(classes, source)
    strong, edge = matched(text, p.strong_terms), matched(text, p.edge_terms)
    none = F.array().cast("array<string>")

    def out(included: bool, reason: str, venue_class: Column | str, found: Column = none) -> Column:
        cls = venue_class if isinstance(venue_class, Column) else F.lit(venue_class)
        return F.struct(F.lit(included).alias("included"), F.lit(reason).alias("reason"), cls.alias("venue_class"), found.alias("matched"))

    has_strong = F.size(strong) > 0
    return (
        F.when(F.coalesce(year, F.lit(0)) < p.min_year, out(False, "before_year_floor", "excluded"))
        .when(F.lower(F.coalesce(language, F.lit(""))) != p.language, out(False, "language_mismatch", "excluded"))
        .when(~F.lower(F.coalesce(kind, F.lit(""))).isin(*p.types), out(False, "document_type_excluded", "excluded"))
        .when(F.coalesce(retracted, F.lit(False)), out(False, "retracted", "excluded"))
        .when(F.length(F.trim(F.coalesce(abstract, F.lit("")))) == 0, out(False, "missing_abstract", "excluded"))
        .when(any_of(text, p.exclusion_terms), out(False, "explicit_exclusion_term", "excluded"))
        .when(venue.isNull() & has_strong & F.coalesce(curated, F.lit(False)), out(True, "curated_edge_allowlist", "edge", strong))
        .when(venue.isNull() & has_strong & F.coalesce(connected, F.lit(False)), out(True, "citation_connected_edge", "edge", strong))
        .when(venue.isNull(), out(False, "source_not_allowed", "excluded", strong))
        .when(~has_strong & (F.size(edge) > 0), out(False, "edge_term_without_core_signal", venue, edge))
        .when(~has_strong, out(False, "topic_gate_failed", venue))
        .otherwise(out(True, "core_source_topic_match", venue, strong))
    )


@dataclass(frozen=True)
class NoiseRule:
    """Rejects a text with one of ``terms`` unless one of ``unless`` stands in it too."""

    reason: str
    terms: tuple[str, ...]
    unless: tuple[str, ...]


@dataclass(frozen=True)
class Bucket:
    """An expansion bucket: a text needs one term of each group; ``deferred`` ones a strong term as well."""

    name: str
    groups: tuple[tuple[str, ...], ...]
    deferred: bool = False


def plan_candidate(p: Policy, noise: tuple[NoiseRule, ...], bucket: Bucket, text: Column, base_reason: Column) -> Column:
    """struct(included, reason): base gate, exclusions, noise rules, then strong terms or the bucket's own."""
    strong = any_of(text, p.strong_terms + p.edge_terms)
    allowed = F.lit(True)
    for group in bucket.groups:
        allowed = allowed & any_of(text, group)

    def out(included: bool, reason: Column | str) -> Column:
        return F.struct(F.lit(included).alias("included"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    chain = F.when(base_reason.isNotNull(), out(False, base_reason)).when(any_of(text, p.exclusion_terms), out(False, "explicit_exclusion_term"))
    for rule in noise:
        chain = chain.when(any_of(text, rule.terms) & ~any_of(text, rule.unless), out(False, rule.reason))
    chain = chain.when(~strong & ~allowed, out(False, "no_strong_topic_or_bucket_allow_signal"))
    if bucket.deferred:
        chain = chain.when(~strong, out(False, "defer_bucket_requires_strong_topic_signal")).when(~allowed, out(False, "defer_bucket_weak_hook"))
    return chain.when(strong & allowed, out(True, "strong_topic_and_bucket_allow")).when(strong, out(True, "strong_topic_signal")).otherwise(out(True, "bucket_allow_signal"))


# The terms of the music-research corpus policy, its noise rules and its expansion buckets.

STRONG_TERMS = (
    "music information retrieval", "audio representation learning", "music tagging", "music transcription", "source separation", "beat tracking", "onset detection", "music similarity", "mir evaluation",
    "self-supervised audio", "contrastive audio", "audio embeddings",
)
EDGE_TERMS = ("neural audio effects", "differentiable dsp", "music generation", "audio generation")
EXCLUSION_TERMS = ("speech recognition", "speaker verification", "biomedical audio", "medical audio")
MUSIC_HOOKS = (
    "music", "musical", "midi", "ismir", "music information retrieval", " mir", "mir ", "playlist", "harmony", "melody", "score", "symbolic", "demix", "musdb", "sisec", "source separation",
    "audio representation", "music tagging", "beat track",
)
MUSIC_POLICY = Policy(2016, "en", ("article", "proceedings-article", "preprint"), EXCLUSION_TERMS, STRONG_TERMS, EDGE_TERMS, {"tismir": "core", "jaes": "core", "ismir": "core"})
NOISE_RULES = (
    NoiseRule("noise_animal_or_non_music_biology", ("manatee", "dugong", "marine mammal", "ornithology", "zoology", "wildlife conservation", "whale song"), MUSIC_HOOKS),
    NoiseRule("noise_generic_database_without_music_hook", ("relational database", "rdbms", "sql server", "database management system"), MUSIC_HOOKS),
    NoiseRule("noise_generic_database_without_music_hook", ("nearest neighbor", "k-nearest neighbor", "knn "), ("music", "audio")),
    NoiseRule("noise_speech_focus_without_music_hook", ("speaker verification", "speaker recognition", "voice biometrics", "automatic speech recognition", "speech-only", "speech only", "text-to-speech", "speech synthesis"), MUSIC_HOOKS),
    NoiseRule("noise_biomedical_audio_without_music_hook", ("medical audio", "biomedical audio", "clinical audio", "patient monitoring audio"), MUSIC_HOOKS),
)
#: Holds for the recommender bucket only.
ECOMMERCE_RULE = NoiseRule("noise_ecommerce_recommendation_without_music", ("e-commerce", "ecommerce", "product recommendation", "shopping cart", "retail recommendation"), ("music",))
BUCKETS = (
    Bucket("core_mir_existing_sources", ()),
    Bucket("audio_ml_signal_processing", (("audio", "signal"), ("music", "mir", "representation", "embedding", "separation", "spectrogram"))),
    Bucket("music_recommender_systems", (("music",), ("recommend", "playlist", "listener", "session"))),
    Bucket("source_separation_benchmarks", (("source separation", "demix", "stem", "musdb", "sisec"), MUSIC_HOOKS)),
    Bucket("cultural_computational_musicology", (("musicology", "computational music", "digital musicology"),), deferred=True),
    Bucket("ethics_law_fairness_user_studies", (("music",), ("fairness", "ethics", "user study", "dataset", "bias")), deferred=True),
)
#: Buckets that take a text with one of several alternatives, each a list of terms that must all stand in it.
ALTERNATIVES = {
    "ismir_proceedings_or_mir_conference": (("ismir",), ("music information retrieval",), ("music retrieval",), ("audio", "music")),
    "symbolic_music_and_harmony": (("harmony",), ("counterpoint",), ("musicxml",), ("score", "music"), ("symbolic music",), ("chord",)),
}


def bucket_allows(name: str, text: Column) -> Column:
    """Whether the bucket of that name takes the text; unknown buckets take none."""
    if name in ALTERNATIVES:
        out = F.lit(False)
        for terms in ALTERNATIVES[name]:
            each = F.lit(True)
            for t in terms:
                each = each & F.contains(text, F.lit(t))
            out = out | each
        return out
    for b in BUCKETS:
        if b.name == name:
            out = F.lit(True)
            for group in b.groups:
                out = out & any_of(text, group)
            return out
    return F.lit(False)
