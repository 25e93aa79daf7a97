"""Settings of one clustering run, passed explicitly to every operator."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Ceiling for tables that describe a model (population, representatives,
# components): their rows travel to every task, so the size is always checked.
MAX_MODEL_ROWS = 50_000

INITS = ("random", "farthest")
SELECTIONS = ("greedy", "crowding", "nearest_child")
SLOTS = ("self", "competitor")
SECOND_CHOICES = ("own", "rep1")


@dataclass(frozen=True)
class EvolveConfig:
    """Hyper-parameters of the evolution and of the labelling that follows it.

    The defaults are those of a distributed run; ``sequential()`` gives those
    of a long single run.
    """

    dims: tuple[str, ...] = ("x0", "x1")
    pop_size: int = 40
    generations: int = 5
    runs: int = 1
    seed: int = 7
    beta: float = 3.0  # initial spread is at most (max - min) / beta
    weight: float = 0.3  # differential weight
    crossover: float = 0.2  # chance that a component is mutated
    eps: float = 1e-5  # smallest spread
    delta1: float = 0.01  # at or under: merge with the closest representative
    delta2: float = 0.05  # above: a cluster of its own
    delta3: float = 0.9  # above: an outlier
    init: str = "random"
    selection: str = "crowding"
    slot: str = "self"
    second: str = "own"
    refine: bool = True
    sample_fraction: float | None = None  # draw the first centroids from a sample
    persist_points: bool = True
    partitions: int | None = None  # of the working points; None: by the scan

    def __post_init__(self):
        object.__setattr__(self, "dims", tuple(self.dims))
        if not self.dims:
            raise ValueError("at least one dimension is needed")
        if self.pop_size < 4:
            raise ValueError("a population needs at least 4 individuals")
        if self.runs < 1 or self.generations < 0:
            raise ValueError("runs must be >= 1 and generations >= 0")
        if self.runs * self.pop_size > MAX_MODEL_ROWS:
            raise ValueError(f"more than {MAX_MODEL_ROWS} individuals; use fewer runs at a time")
        if self.sample_fraction is not None and not 0 < self.sample_fraction <= 1:
            raise ValueError("sample_fraction must lie in (0, 1]")
        for name, allowed in (
            ("init", INITS),
            ("selection", SELECTIONS),
            ("slot", SLOTS),
            ("second", SECOND_CHOICES),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @classmethod
    def sequential(cls, n_points: int | None = None, **changes) -> "EvolveConfig":
        """Long-run settings: 300 generations, crossover 0.8 and a population of
        100, or half the points where there are fewer than 200."""
        size = 100 if n_points is None else min(n_points // 2, 100)
        base = dict(generations=300, pop_size=size, crossover=0.8)
        return cls(**{**base, **changes})

    def with_(self, **changes) -> "EvolveConfig":
        return replace(self, **changes)

    @property
    def centre_cols(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.dims))]

    @property
    def spread_cols(self) -> list[str]:
        return [f"s{k}" for k in range(len(self.dims))]
