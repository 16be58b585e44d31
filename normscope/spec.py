"""The declared meaning of an event log: which columns play which part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from . import constants as C


@dataclass(frozen=True)
class EventSpec:
    """Column roles. ``dimensions`` are dropped from the right when a scope is too thin."""

    name: str = "events"
    entity: str = "entity_id"
    time: str = "ts"
    event_id: str = "event_id"
    entity_type: str = "entity"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    rates: tuple[str, ...] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    min_score: float = C.MIN_SCORE
    extra_detectors: tuple[str, ...] = ()  # registered beside the six

    def __post_init__(self) -> None:
        if not (self.numeric or self.categorical):
            raise ValueError("a spec needs at least one numeric or categorical feature")
        unknown = set(self.weights) - set(C.DETECTORS) - set(self.extra_detectors)
        if unknown:
            raise ValueError(f"unknown detectors in weights: {sorted(unknown)}")

    @property
    def detector_weights(self) -> dict[str, float]:
        every = {**C.DETECTOR_WEIGHTS, **{d: 1.0 for d in self.extra_detectors}}
        return {d: float(self.weights.get(d, w)) for d, w in every.items()}

    @property
    def columns(self) -> list[str]:
        """Every column that a detection run reads."""
        return list(dict.fromkeys([self.event_id, self.entity, self.time, *self.numeric, *self.categorical, *self.dimensions, *self.rates]))

    @classmethod
    def from_dict(cls, payload: Mapping[str, object]) -> EventSpec:
        listed = {k: tuple(payload.get(k) or ()) for k in ("numeric", "categorical", "dimensions", "rates", "extra_detectors")}
        plain = {k: payload[k] for k in ("name", "entity", "time", "event_id", "entity_type", "min_score") if k in payload}
        return cls(**plain, **listed, weights=dict(payload.get("weights") or {}))

    def as_dict(self) -> dict[str, object]:
        return {
            "name": self.name, "entity": self.entity, "time": self.time, "event_id": self.event_id, "entity_type": self.entity_type,
            "numeric": list(self.numeric), "categorical": list(self.categorical), "dimensions": list(self.dimensions), "rates": list(self.rates),
            "weights": dict(self.weights), "min_score": self.min_score, "extra_detectors": list(self.extra_detectors),
        }


def check_registration(spec: EventSpec, known: Sequence[str]) -> None:
    """A name may be registered once for each tenant."""
    if spec.name in known:
        raise ValueError(f"a schema named {spec.name!r} exists")
