"""Declared roles of a table's columns."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class DatasetSpec:
    """Column roles, bounds and domains, and how the table is read."""

    continuous: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    target: str | None = None
    pii: list[str] = field(default_factory=list)
    exclude_features: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    domains: dict[str, list[str]] = field(default_factory=dict)
    sep: str = ","
    header: bool = True
    names: list[str] | None = None
    na_values: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        extra = [self.target] if self.target and self.target not in [*self.continuous, *self.categorical] else []
        return [*self.continuous, *self.categorical, *extra]

    @classmethod
    def from_dict(cls, given: dict, defaults: dict | None = None) -> DatasetSpec:
        """From nested dicts, the given one merged over the defaults; unknown keys are an error."""
        merged = merge(defaults or {}, given)
        unknown = set(merged) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        return cls(**merged)


def merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
