"""Settings of network analyses, with their checks and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from tidewire.operators.permutation import Permutation
from tidewire.operators.significance import check_n_perm


@dataclass
class Settings:
    """One object for all analyses; ``of`` builds it from a dict and refuses unknown keys."""

    estimator: Any = None
    estimator_options: dict = field(default_factory=dict)
    max_lag_sources: int | None = None
    min_lag_sources: int = 1
    max_lag_target: int | None = None
    tau_sources: int = 1
    tau_target: int = 1
    max_lag: int | None = None
    tau: int = 1
    add_conditionals: Any = None
    local_values: bool = False
    n_perm_max_stat: int = 200
    n_perm_min_stat: int = 500
    n_perm_omnibus: int = 500
    n_perm_max_seq: int = 500
    n_perm_mi: int = 500
    alpha_max_stat: float = 0.05
    alpha_min_stat: float = 0.05
    alpha_omnibus: float = 0.05
    alpha_max_seq: float = 0.05
    alpha_mi: float = 0.05
    permute_in_time: bool = False
    perm_type: str = "random"
    max_shift: int | None = None
    block_size: int | None = None
    perm_range: int | None = None
    fdr_correction: bool = True
    alpha_fdr: float = 0.05
    correct_by_target: bool = True
    fdr_constant: int = 2
    stats_type: str | None = None
    n_perm_comp: int = 500
    alpha_comp: float = 0.05
    tail_comp: str = "two"
    seed: int = 1
    checkpoint_path: str | None = None

    @classmethod
    def of(cls, given: dict | Settings) -> Settings:
        if isinstance(given, Settings):
            return given
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise RuntimeError(f"unknown settings {sorted(unknown)}")
        return cls(**given)

    def permutation(self) -> Permutation:
        return Permutation(self.perm_type, self.max_shift, self.block_size, self.perm_range)

    def check_network(self, with_target_past: bool) -> None:
        if self.estimator is None:
            raise RuntimeError("an estimator is needed")
        for name in ("max_lag_sources", "min_lag_sources"):
            value = getattr(self, name)
            if not isinstance(value, int) or value < 0:
                raise RuntimeError(f"{name} is an integer of at least 0, not {value!r}")
        if self.min_lag_sources > self.max_lag_sources:
            raise RuntimeError("min_lag_sources exceeds max_lag_sources")
        _check_tau("tau_sources", self.tau_sources, self.max_lag_sources)
        if with_target_past:
            if self.max_lag_target is None:
                self.max_lag_target = self.max_lag_sources
            if not isinstance(self.max_lag_target, int) or self.max_lag_target < 1:
                raise RuntimeError("max_lag_target is an integer of at least 1")
            _check_tau("tau_target", self.tau_target, self.max_lag_target)
        self._check_tests("max_stat", "min_stat", "omnibus", "max_seq")

    def check_storage(self) -> None:
        if self.estimator is None:
            raise RuntimeError("an estimator is needed")
        if not isinstance(self.max_lag, int) or self.max_lag < 1:
            raise RuntimeError("max_lag is an integer of at least 1")
        _check_tau("tau", self.tau, self.max_lag)
        self._check_tests("max_stat", "min_stat", "mi")

    def _check_tests(self, *names: str) -> None:
        for name in names:
            alpha = getattr(self, f"alpha_{name}")
            if not 0 < alpha < 1:
                raise ValueError(f"alpha_{name} lies between 0 and 1")
            check_n_perm(getattr(self, f"n_perm_{name}"), alpha)


def _check_tau(name: str, tau: int, most: int) -> None:
    if not isinstance(tau, int) or tau < 1 or (most and tau > most):
        raise RuntimeError(f"{name} is an integer between 1 and the largest lag")
