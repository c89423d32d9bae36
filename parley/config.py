"""Settings of an analysis run, validated on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Thresholds of the operators; ``None`` in an override keeps what is there."""

    enter: float = 0.50
    leave: float = 0.35
    least_event_ms: int = 300
    merge_gap_ms: int = 200
    least_segment_ms: int = 50
    speaker_gap_ms: int = 1_000
    least_overlap_ms: int = 50
    onset_ms: int = 150
    assign_cosine: float = 0.70
    review_cosine: float = 0.60
    centroid_weight: float = 0.30
    chunk_from_ms: int = 3_600_000
    chunk_ms: int = 1_200_000
    chunk_lap_ms: int = 30_000
    timeline: str = "auto"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "timeline":
                if value not in ("auto", "always", "never"):
                    raise ValueError(f"timeline must be auto, always or never, not {value!r}")
            elif isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or value < 0:
                raise ValueError(f"{f.name} must be a number from 0 on, not {value!r}")
            elif f.type == "float" and value > 1:
                raise ValueError(f"{f.name} must be at most 1, not {value!r}")
            elif f.type == "int" and value != int(value):
                raise ValueError(f"{f.name} must be whole, not {value!r}")
        if self.leave > self.enter or self.review_cosine > self.assign_cosine:
            raise ValueError("the lower threshold lies above the upper one")

    def with_overrides(self, overrides: Mapping[str, object]) -> Settings:
        """A copy with the given values; unknown names are refused."""
        unknown = sorted(set(overrides) - {f.name for f in fields(self)})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})

    def as_dict(self) -> dict[str, object]:
        return asdict(self)
