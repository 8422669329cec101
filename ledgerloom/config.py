"""Parameters of the analyses, with the defaults in common use."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class Detector:
    """How transfers are cut into windows and linked to candidate groups; a limit of 0 is off."""

    formats: tuple[str, ...] | None = ("ACH",)
    min_amount: float = 0.0
    window_hours: int = 72
    stride_hours: int = 24
    max_degree: int = 60
    min_txns: int = 3
    min_accounts: int = 3
    max_txns: int = 100
    max_accounts: int = 60

    @property
    def width(self) -> int:
        return self.window_hours * HOUR_US

    @property
    def stride(self) -> int:
        return self.stride_hours * HOUR_US


@dataclass(frozen=True)
class Policy:
    block_score: float = 0.90
    block_confidence: float = 0.80
    block_amount: float = 10_000_000.0
    hold_score: float = 0.50


@dataclass(frozen=True)
class Limits:
    max_accounts: int = 25
    freeze_hours: int = 72
    watch_hours: int = 14 * 24


@dataclass(frozen=True)
class Evaluation:
    cover: float = 0.5
    purity: float = 0.5
    budgets: tuple[int, ...] = (50, 100, 250, 500, 1000, 2500, 5000)


@dataclass(frozen=True)
class Training:
    epochs: int = 300
    rate: float = 0.1
    l2: float = 1e-4
    positive_weight: float | None = None


@dataclass(frozen=True)
class RegistrySpec:
    coverage: float = 0.30
    delay_hours: float = 72.0
    false_rate: float = 0.05
    seed: int = 1


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    sample: int = 256
    seed: int = 1


@dataclass(frozen=True)
class Geometry:
    """A pass of windows; leases of its blocks last ``freeze_hours``."""

    window_hours: int
    stride_hours: int
    name: str = field(default="")


def parse_geometries(text: str) -> list[Geometry]:
    """``"72/24,24/6"`` as geometries; every stride must be positive and at most its width."""
    out = []
    for part in text.split(","):
        try:
            w, s = (int(x) for x in part.strip().split("/"))
        except ValueError as e:
            raise ValueError(f"not a geometry: {part!r}") from e
        if not 0 < s <= w:
            raise ValueError(f"stride must be in 1..{w}: {part!r}")
        out.append(Geometry(w, s, part.strip()))
    return out
