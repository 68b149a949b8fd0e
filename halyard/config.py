"""Frozen, checked settings. Their canonical hash is part of every content key."""

from __future__ import annotations

import math
import tomllib
from dataclasses import asdict, dataclass, field, fields

from .operators.evidence import Thresholds
from .operators.incremental import parameter_hash
from .operators.measures import WEIGHTS
from .operators.ranking import Weights


def _finite(x, name: str) -> None:
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError(f"{name} must be finite")


@dataclass(frozen=True)
class Quality:
    edge: int = 1024
    weights: tuple = WEIGHTS

    def __post_init__(self):
        if tuple(self.weights) != WEIGHTS:
            raise ValueError("the weights of the quality score are fixed")
        if self.edge < 1:
            raise ValueError("edge must be positive")


@dataclass(frozen=True)
class Events:
    method: str = "time"
    gap_minutes: float = 120
    coarse_gap_minutes: float = 240
    max_span_hours: float = 18
    visual_weight: float = 0.3
    time_weight: float = 0.7
    epsilon: float = 0.25
    min_samples: int = 2
    neighbours: int = 64
    window_limit: int = 256
    pure_visual: bool = False

    def __post_init__(self):
        if self.method not in ("time", "dbscan", "hdbscan"):
            raise ValueError(f"no event method: {self.method}")
        if not 0 < self.max_span_hours <= 24 or self.gap_minutes <= 0 or self.coarse_gap_minutes <= 0:
            raise ValueError("gaps must be positive and the span at most 24 hours")
        if abs(self.visual_weight + self.time_weight - 1) > 1e-9 or min(self.visual_weight, self.time_weight) < 0:
            raise ValueError("event weights must not be negative and sum to 1")
        if self.min_samples < 1 or self.neighbours < 1:
            raise ValueError("min_samples and neighbours must be positive")


@dataclass(frozen=True)
class Config:
    quality: Quality = field(default_factory=Quality)
    duplicates: Thresholds = field(default_factory=Thresholds)
    events: Events = field(default_factory=Events)
    ranking: Weights = field(default_factory=Weights)

    def __post_init__(self):
        for section in fields(self):
            for k, v in asdict(getattr(self, section.name)).items():
                _finite(v, f"{section.name}.{k}")
        t, w = self.duplicates, self.ranking
        if any(not 0 <= getattr(t, k) <= 64 for k in ("phash", "dhash", "ahash", "burst_phash", "burst_dhash", "burst_ahash", "recovery_phash", "recovery_hash")):
            raise ValueError("hash distances lie within 0 and 64")
        if w.variant not in ("A", "B") or abs(w.quality + w.representation + w.uniqueness - 1) > 1e-9:
            raise ValueError("ranking weights must sum to 1, for variant A or B")
        if not 1 <= w.peers <= 128 or any(not 0 <= getattr(w, k) <= 1 for k in ("quality", "representation", "uniqueness", "cap", "floor", "burst_quality", "diversity", "coverage")):
            raise ValueError("ranking shares lie within 0 and 1, peers within 1 and 128")

    def key(self) -> str:
        return parameter_hash(asdict(self))

    @classmethod
    def of(cls, sections: dict) -> Config:
        """From a snapshot, as asdict() makes it, or parsed TOML; unknown sections and settings are refused."""
        kinds = {"quality": Quality, "duplicates": Thresholds, "events": Events, "ranking": Weights}
        made = {}
        for name, values in sections.items():
            if name not in kinds:
                raise ValueError(f"no section: {name}")
            unknown = set(values) - {f.name for f in fields(kinds[name])}
            if unknown:
                raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
            made[name] = kinds[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
        return cls(**made)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, "rb") as f:
            return cls.of(tomllib.load(f))
