"""Every threshold of the analysis, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """Word lists of one language; larger ones are read with sources.resources."""

    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    negators: tuple[str, ...] = ()
    positive_signals: tuple[str, ...] = ()
    negative_signals: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    frequent: tuple[str, ...] = ()


#: The Russian negators and signal words that the scores are defined with.
RUSSIAN = Lexicon(
    negators=("не", "ни", "нет", "без", "нельзя", "никогда"),
    positive_signals=("за", "поддерживаю", "согласен", "согласна", "одобряю", "верно", "правильно", "наконец", "давно_пора", "молодцы", "респект"),
    negative_signals=("против", "зачем", "почему", "куда", "хватит", "доколе", "сколько_можно", "надоело", "устали", "достало", "увы", "жаль", "к_сожалению"),
)

#: A small Latin-letter lexicon that gives results on the synthetic texts.
LATIN = Lexicon(
    positive=("thing", "heand", "for", "with", "ed"),
    negative=("idiot", "scum", "trash", "stupid", "worthless", "re"),
    negators=("not", "the", "no"),
    positive_signals=("that", "it"),
    negative_signals=("was", "is"),
    stop_words=("the", "of", "and", "to", "in", "a", "de", "la", "der", "die"),
    frequent=("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by"),
)


@dataclass(frozen=True)
class Params:
    """Thresholds of all operators."""

    current_days: int = 30
    baseline_days: int = 60
    max_text: int = 15_000
    language_ok: float = 0.5
    language_uncertain: float = 0.30
    l1_confident: float = 0.50
    l1_zero: float = 0.01
    secondary_weight: float = 0.3
    semantic: float = 0.55
    exact_min_length: int = 30
    near_min_length: int = 100
    near_similarity: float = 0.90
    near_hours: int = 72
    original_min_length: int = 20
    repost_comment_min_length: int = 30
    low_confidence: float = 0.15
    negation_window: int = 3
    bootstrap: int = 1000
    bootstrap_outer: int = 300
    bootstrap_inner: int = 100
    confidence: float = 0.95
    huber_k: float = 1.345
    min_topic_posts: tuple[int, int] = (3, 10)
    min_comments: tuple[int, int] = (10, 50)
    max_ci_width: tuple[float, float] = (0.50, 0.20)
    min_post_comments: int = 5
    lexicon: Lexicon = field(default_factory=lambda: RUSSIAN)


DEFAULT = Params()

#: Parameters of the sensitivity analysis (name, default, low, high, category).
SENSITIVITY = (
    ("huber_k", 1.345, 1.0, 1.7, "ROBUST_STATS"),
    ("bootstrap_B", 1000.0, 500.0, 2000.0, "BOOTSTRAP"),
    ("bootstrap_B_outer", 300.0, 100.0, 1000.0, "BOOTSTRAP"),
    ("bootstrap_B_inner", 100.0, 100.0, 1000.0, "BOOTSTRAP"),
    ("confidence_level", 0.95, 0.90, 0.99, "BOOTSTRAP"),
    ("levenshtein_threshold", 0.90, 0.80, 0.95, "DEDUP"),
    ("dedup_window_hours", 72.0, 24.0, 168.0, "DEDUP"),
    ("sufficiency_min_topic_posts_reliable", 10.0, 5.0, 20.0, "SUFFICIENCY"),
    ("sufficiency_min_comments_reliable", 50.0, 20.0, 100.0, "SUFFICIENCY"),
    ("sufficiency_max_ci_width_reliable", 0.20, 0.10, 0.30, "SUFFICIENCY"),
    ("baseline_window_days", 60.0, 30.0, 120.0, "COLLECTION"),
    ("semantic_threshold", 0.55, 0.40, 0.70, "TOPIC"),
    ("confident_l1_threshold", 0.50, 0.30, 0.70, "TOPIC"),
    ("low_confidence_threshold", 0.15, 0.10, 0.20, "SENTIMENT"),
    ("orig_repost_comment_w", 0.5, 0.3, 0.7, "ORIGINALITY"),
)
