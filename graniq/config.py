"""Search settings and their overlays."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of a search. A 0 for these means the default: top_k, per_leg, rrf_k, min_vector_score, budget_tokens, max_per_document."""

    top_k: int = 8
    per_leg: int = 24
    rrf_k: float = 60.0
    weight_vector: float = 1.0
    weight_section: float = 0.8
    weight_lexical: float = 0.7
    weight_trigram: float = 0.5
    weight_path: float = 0.4
    min_vector_score: float = 0.15
    neighbor_window: int = 1
    max_per_document: int = 3
    budget_tokens: int = 6000
    rerank: bool = False
    rerank_candidates: int = 30

    def resolved(self) -> SearchConfig:
        base = SearchConfig()
        names = ("top_k", "per_leg", "rrf_k", "min_vector_score", "budget_tokens", "max_per_document", "rerank_candidates")
        return replace(self, **{n: getattr(self, n) or getattr(base, n) for n in names})

    @property
    def pool(self) -> int:
        """Chunks that go on after fusion."""
        return max(self.rerank_candidates if self.rerank else 3 * self.top_k, self.top_k)

    @property
    def weights(self) -> list[float]:
        return [self.weight_vector, self.weight_section, self.weight_lexical, self.weight_trigram, self.weight_path]


LEGS = ["vector", "section", "lexical", "trigram", "path"]


def overlay(*layers: dict[str, Any]) -> SearchConfig:
    """Defaults under the layers, later ones first; unknown keys and nulls are passed over."""
    known = {f.name for f in fields(SearchConfig)}
    out: dict[str, Any] = {}
    for layer in layers:
        out |= {k: v for k, v in (layer or {}).items() if k in known and v is not None}
    return SearchConfig(**out)


def check_setting(key: str, value: Any) -> Any:
    """A setting's value; unknown keys are an error, and a masked secret means no change (None)."""
    if key not in {f.name for f in fields(SearchConfig)}:
        raise KeyError(f"no setting {key}")
    return None if isinstance(value, str) and ("…" in value or (value and set(value) == {"*"})) else value
