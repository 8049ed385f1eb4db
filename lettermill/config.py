"""Thresholds and sizes of classification, batching and cost; every function takes them as a value."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Labels in the order that breaks ties.
LABELS = ("now", "later", "brief", "noise")
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Config:
    known_min_sent: int = 3
    known_max_age_days: int = 180
    never_answered_min: int = 5
    escalate_below: float = 0.75
    ceiling: float = 0.9
    batch_size: int = 10
    body_chars: int = 2000
    subject_chars: int = 200
    lookback_days: int = 7
    history_cap: int = 500
    cache_cap: int = 20_000
    folders: dict[str, str] = field(default_factory=lambda: {"later": "Later", "brief": "Brief", "noise": "Noise"})
