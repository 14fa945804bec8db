"""The configuration of a run: a frozen record that goes to JSON and back, and named presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class GroundPass:
    """One pass of a ground filter with its parameters, in metres."""

    kernel: str = "smrf"
    window: float = 32.0
    slope: float = 0.158
    threshold: float = 0.25
    scalar: float = 0.0
    cell: float = 1.0

    def parameters(self) -> dict:
        if self.kernel == "smrf":
            return {"window": self.window, "slope": self.slope, "threshold": self.threshold, "scalar": self.scalar, "cell": self.cell}
        return {"window": self.window, "cell": self.cell} if self.kernel == "pmf" else {}


@dataclass(frozen=True)
class Config:
    ground: str = "passes"  # or "adjudicated"
    passes: tuple[GroundPass, ...] = (GroundPass(),)
    overrides: dict = field(default_factory=dict)
    cleanup: bool = True
    cleanup_height_cm: float = 20.0
    cleanup_radius_dm: int = 8
    dedupe: str = "mean"
    engine: str = "minimum curvature"
    neighbours: int = 16
    radius_m: float | None = None
    cell_m: float | None = None
    strip_cells: int = 0
    erode_cells: int = 0
    fill_voids: bool = True
    relief: bool = False

    def __post_init__(self):
        from ..operators.ground import KERNELS
        from ..operators.surface import engine

        if self.ground not in ("passes", "adjudicated"):
            raise ValueError(f"unknown ground engine {self.ground}")
        if bad := [p.kernel for p in self.passes if p.kernel not in KERNELS]:
            raise ValueError(f"unknown filters: {', '.join(bad)}")
        engine(self.engine)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Config:
        d = json.loads(text)
        if unknown := sorted(set(d) - {f.name for f in fields(Config)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return Config(**{**d, "passes": tuple(GroundPass(**p) for p in d.get("passes", [asdict(GroundPass())]))})


PRESETS = {"baseline": Config(cleanup=False), "cleanup": Config(), "adjudicated": Config(ground="adjudicated"), "kriging": Config(engine="kriging"), "fast": Config(engine="idw", cleanup=False)}


def load(preset: str = "cleanup", **overrides) -> Config:
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}; there are {', '.join(PRESETS)}")
    return replace(PRESETS[preset], **overrides)


def differences(config: Config, preset: str) -> dict[str, tuple]:
    """Which settings differ from a preset's, and how."""
    base, own = asdict(PRESETS[preset]), asdict(config)
    return {k: (base[k], own[k]) for k in base if base[k] != own[k]}
