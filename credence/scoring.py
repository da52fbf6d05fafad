"""From check results to one weighted score."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Component -> checks.
COMPONENT_CHECKS = {
    "data_quality": ("data_quality", "duplicates"), "window_stability": ("conversion_window",), "identity_robustness": ("identity_loss", "touchpoint_loss", "event_loss"),
    "path_quality": ("path_sparsity", "channel_concentration"), "model_agreement": ("model_disagreement",), "temporal_stability": ("model_stability",),
}


@dataclass(frozen=True)
class ScoringWeights:
    data_quality: float = 0.20
    window_stability: float = 0.15
    identity_robustness: float = 0.15
    path_quality: float = 0.15
    model_agreement: float = 0.20
    temporal_stability: float = 0.15

    def __post_init__(self):
        values = [getattr(self, f.name) for f in fields(self)]
        if any(isinstance(v, bool) or not isinstance(v, int | float) for v in values):
            raise ValueError("weights must be numbers")
        if min(values) < 0 or sum(values) <= 0:
            raise ValueError("weights must not be negative and not all 0")


    @classmethod
    def of(cls, given: ScoringWeights | Mapping[str, float] | None) -> ScoringWeights:
        """Weights as they are, or the defaults with those of a mapping in their place."""
        if given is None or isinstance(given, cls):
            return given or cls()
        unknown = set(given) - set(COMPONENT_CHECKS)
        if unknown:
            raise ValueError(f"unknown components: {sorted(unknown)}")
        return cls(**given)


@dataclass(frozen=True)
class ScoreThresholds:
    """Least scores of the bands. Edges and names."""

    robust: float = 90.0
    stable: float = 80.0
    caution: float = 70.0
    fragile: float = 60.0

    def __post_init__(self):
        edges = [getattr(self, f.name) for f in fields(self)]
        if edges != sorted(edges, reverse=True):
            raise ValueError("each band must begin where the next better one ends")


def component_scores(scores: dict[str, float]) -> dict[str, float]:
    """Mean score of the evaluated checks of each component."""
    out = {}
    for name, checks in COMPONENT_CHECKS.items():
        got = [scores[c] for c in checks if c in scores]
        if got:
            out[name] = sum(got) / len(got)
    return out


def reliability_score(scores: dict[str, float], weights: ScoringWeights | Mapping[str, float] | None = None) -> float | None:
    """Weighted mean over the components that have evidence; none: no score."""
    weights, parts = ScoringWeights.of(weights), component_scores(scores)
    total = sum(getattr(weights, c) for c in parts)
    return sum(v * getattr(weights, c) for c, v in parts.items()) / total if total else None


def score_label(score: float | None, thresholds: ScoreThresholds | None = None) -> str:
    """The name of the band that holds the score."""
    if score is None:
        return "Insufficient Evidence"
    edges = thresholds or ScoreThresholds()
    named = (("robust", "Robust"), ("stable", "Stable"), ("caution", "Caution"), ("fragile", "Fragile"))
    return next((label for field, label in named if score >= getattr(edges, field)), "Highly Fragile")


def grade(score: float | None) -> str:
    """The same bands as a letter, always by the default edges."""
    return {"Robust": "A", "Stable": "B", "Caution": "C", "Fragile": "D", "Highly Fragile": "F"}.get(score_label(score), "N/A")


def combine_scores(scores: list[float]) -> float:
    """The mean of check scores, 100 where there is none."""
    return sum(scores) / len(scores) if scores else 100.0
