"""Parameters of the operators, as frozen dataclasses; `from_mapping` overlays a nested mapping such as parsed YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class ZoneConfig:
    base_range: float = 1.6
    base_body: float = 0.7
    base_cluster: float = 2.5
    min_base: int = 1
    max_base: int = 3
    departure_floor: float = 0.7
    departure_close: float = 0.8
    leg_max: int = 4
    leg_pullback: float = 0.7
    leg_clear: float = 1.0
    leg_in_enabled: bool = False
    leg_in_lookback: int = 3
    leg_in_min_move: float = 0.0
    arrival_mode: str = "any"  # any, reversal, optional
    arrival_origin: bool = False
    containment: bool = True
    containment_price: str = "body"  # body, wick
    invalidation: str = "close"  # close, wick
    departure_weight: float = 0.50
    tightness_weight: float = 0.20
    arrival_weight: float = 0.15
    volume_weight: float = 0.15
    base_volume_weight: float = 0.10
    base_volume_low: float = 0.70
    base_volume_high: float = 1.30
    trend_weight: float = 0.10
    trend_full: float = 2.0
    quality_leg_out: float = 0.34
    quality_base: float = 0.22
    quality_disp: float = 0.12
    quality_trend: float = 0.12
    quality_leg_in: float = 0.05
    quality_volume: float = 0.10
    merge_overlap: float = 0.5
    merge_gap: int = 60
    max_zero_volume: float = 0.01
    strength_bonus: float = 0.08
    htf_overlap: float = 0.30
    decay: tuple[float, ...] = (1.0, 0.85, 0.65, 0.45)
    min_quality: float = 0.0
    #: strict: trades and features only after the leg confirms the zone, merges keep the first member.
    strict: bool = False


@dataclass(frozen=True)
class TradeConfig:
    capital: float = 500_000.0
    risk: float = 0.01
    reward: float = 2.0
    max_hold: int = 5
    slippage: float = 0.0
    commission: float = 0.0
    confirm: bool = False
    stop_atr: float = 0.0
    trail: bool = False
    trail_trigger: float = 1.0
    trail_atr: float = 1.5
    trail_floor: float = 0.5
    target_first: bool = False
    min_strength: float | None = None
    max_strength: float | None = None
    structures: tuple[str, ...] = ("DBR", "RBD", "RBR", "DBD")


@dataclass(frozen=True)
class Config:
    zones: ZoneConfig = field(default_factory=ZoneConfig)
    trades: TradeConfig = field(default_factory=TradeConfig)

    @classmethod
    def from_mapping(cls, given: dict) -> Config:
        """Unknown names are refused, so that a misspelt key can't pass unnoticed."""
        out = cls()
        for part, values in given.items():
            own = getattr(out, part)
            unknown = set(values) - {f.name for f in fields(own)}
            if unknown:
                raise ValueError(f"unknown keys in {part}: {sorted(unknown)}")
            out = replace(out, **{part: replace(own, **values)})
        return out
