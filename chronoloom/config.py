"""Settings of the engine, typed and immutable."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from chronoloom.errors import ConfigError


@dataclass(frozen=True)
class Config:
    extractor: str = "surface"
    chunking: str = "turns"
    chunk_target: int = 1200
    chunk_max: int = 2400
    long_doc_chars: int = 6000
    gap_hours: float = 4.0
    fact_margin: float = 0.3
    hub_cap: int = 256
    knn: int = 6
    knn_floor: float = 0.55
    ppr_alpha: float = 0.5
    rrf_k: int = 60
    mmr_lambda: float = 1.0
    context_episodes: int = 5
    per_source: int = 2
    max_facts: int = 30
    sibling_span: int = 2
    sibling_budget: int = 60000

    def override(self, raw: str) -> Config:
        """A copy with ``name=value`` set, the value read by the field's type."""
        name, eq, value = raw.partition("=")
        kinds = {f.name: f.type for f in fields(self)}
        if not eq or name not in kinds:
            raise ConfigError(f"unknown setting {name!r}: {', '.join(sorted(kinds))}")
        try:
            return replace(self, **{name: {"int": int, "float": float, "str": str}[kinds[name]](value)})
        except ValueError as e:
            raise ConfigError(f"{name} takes {kinds[name]}, not {value!r}") from e


TIERS = {"micro": Config(context_episodes=3, knn=3), "default": Config(), "wide": Config(context_episodes=8, knn=12)}
