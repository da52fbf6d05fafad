"""Limits of the checks. The defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ConversionWindowThresholds:
    low_spearman: float = 0.90
    high_spearman: float = 0.70
    share_volatility: float = 0.10
    high_share_volatility: float = 0.20
    high_risk_share_change: float = 0.10
    high_risk_rank_change: float = 2.0


@dataclass(frozen=True)
class ContaminationThresholds:
    medium_rate: float = 0.05
    high_rate: float = 0.15
    critical_rate: float = 0.30


@dataclass(frozen=True)
class ExposureThresholds:
    touch_count_ratio: float = 2.0
    channel_mix_distance: float = 0.25
    high_channel_mix_distance: float = 0.50


@dataclass(frozen=True)
class TemporalStabilityThresholds:
    share_volatility: float = 0.10
    high_share_volatility: float = 0.20
    rank_volatility: float = 2.0
    conversion_rate_drift: float = 0.10
    transition_stability: float = 0.80
