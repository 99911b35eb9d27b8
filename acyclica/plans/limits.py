"""Sizes and deadlines that choose between plans."""

from __future__ import annotations

import time
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    #: A component (or a whole graph) of at most so many edges is finished by one task; a few MB.
    local_edges: int = 50_000
    max_rounds: int = 200


@dataclass
class Deadline:
    """Seconds that an anytime query may take; asked between rounds, so an incumbent is always whole."""

    seconds: float | None = None
    began: float = field(default_factory=time.monotonic)

    def over(self) -> bool:
        return self.seconds is not None and time.monotonic() - self.began >= self.seconds


@dataclass(frozen=True)
class Regime:
    """What a greedy pass takes at a time (1 / fraction of a component's vertices) and how long it improves."""

    fraction: int
    rounds: int
    window: int


def regime(edges: int) -> Regime:
    """By the size of the original graph."""
    if edges <= 460_000:
        return Regime(150, 250, 10)
    if edges <= 2_300_000:
        return Regime(100, 20, 10)
    return Regime(50, 10, 5)


#: Ranking by PageRank pays on graphs with fewer vertices and edges only; others rank by degree product.
PAGERANK_VERTICES, PAGERANK_EDGES = 10_000, 100_000


def pagerank_fits(vertices: int, edges: int) -> bool:
    return vertices < PAGERANK_VERTICES and edges < PAGERANK_EDGES
