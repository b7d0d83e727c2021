"""The tunables of a search, with their bounds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

# Bounds or choices of each tunable.
BOUNDS = {"scene_count": (3, 8), "products_per_scene": (8, 40), "expansion_terms": (0, 12), "recall_limit": (5, 200), "temperature": (0.0, 1.0)}
CHOICES = {"stock_filter": ("all", "in_stock"), "rerank_provider": ("jev", "deepseek", "off")}


@dataclass(frozen=True)
class SearchParams:
    scene_count: int = 6
    products_per_scene: int = 16
    expansion_terms: int = 0
    recall_limit: int = 30
    stock_filter: str = "all"
    rerank_provider: str = "jev"
    temperature: float = 0.2

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            if isinstance(getattr(self, name), bool) or not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    @classmethod
    def settled(cls, saved: dict) -> SearchParams:
        """Saved settings held to today's bounds; what is unknown or no longer allowed falls back to its default."""
        out = asdict(cls())
        for name, value in saved.items():
            if name in BOUNDS and isinstance(value, (int, float)) and not isinstance(value, bool):
                low, high = BOUNDS[name]
                out[name] = type(out[name])(min(max(value, low), high))
            elif name in CHOICES and value in CHOICES[name]:
                out[name] = value
        return cls(**out)

    @classmethod
    def schema(cls) -> list[dict]:
        """field, default, least, most, choices: for a form."""
        return [{"field": f.name, "default": f.default, "least": BOUNDS.get(f.name, (None, None))[0], "most": BOUNDS.get(f.name, (None, None))[1], "choices": list(CHOICES.get(f.name, ()))} for f in fields(cls)]
