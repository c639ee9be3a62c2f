"""Knobs of the analysis, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Labels of the error profile's synthetic roots.
ON_PATH_ROOT = "errorCriticalPathSyntheticRoot"
OFF_PATH_ROOT = "fullErrorsNonCPSyntheticRoot"
INCOMPLETE_WARNING = "invalid parent span IDs"


@dataclass(frozen=True)
class Knobs:
    """overlap: share of the parent by which serial siblings may overlap; lengthening: by how much a call may outlast its caller;
    root: (service, operation) of the node to analyse as root (None: every root); sole_root: analyse only traces with one
    root, which must match; proxies, pass_through and excluded: (service, operation) pairs; test_services and
    test_prefixes mark test traces."""

    overlap: float = 0.01
    lengthening: float = 1.01
    root: tuple[str, str] | None = None
    sole_root: bool = False
    proxies: frozenset[tuple[str, str]] = frozenset()
    pass_through: frozenset[tuple[str, str]] = frozenset()
    excluded: frozenset[tuple[str, str]] = frozenset()
    test_services: frozenset[str] = frozenset()
    test_prefixes: tuple[str, ...] = ()
    strategy: str = "series"

    def but(self, **changes) -> Knobs:
        return replace(self, **changes)

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < 1:
            raise ValueError("overlap must lie in [0, 1)")
        if self.lengthening < 1:
            raise ValueError("lengthening must be 1 at least")
        if self.strategy not in ("series", "generic", "pessimistic", "optimistic"):
            raise ValueError(f"unknown strategy {self.strategy}")
