"""Search options and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.vectors import METRICS


@dataclass(frozen=True)
class SearchOptions:
    """k results a query; dims and rerank for two-stage flat search; nprobe, ef and top_p for indexes."""

    k: int = 10
    metric: str = "ip"
    dims: int | None = None
    rerank: int = 0
    nprobe: int = 4
    top_p: int = 50
    ef: int = 64
    local_p: int | None = None

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {sorted(METRICS)}")
        if self.rerank and self.rerank < self.k:
            raise ValueError("rerank must be 0 or at least k")
        if self.dims is not None and self.dims < 1:
            raise ValueError("dims must be positive")
        if min(self.nprobe, self.top_p, self.ef) < 1:
            raise ValueError("nprobe, top_p and ef must be positive")

    @property
    def candidates(self) -> int:
        return max(self.k, self.top_p)

    @property
    def beam(self) -> int:
        return max(self.k, self.ef)
