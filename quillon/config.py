"""Parameters of the analyses, with the defaults of the reference workload."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    measure_point: float = 0.5
    n_formants: int = 5
    n_perm: int = 999
    max_tokens: int = 2000
    n_boot: int = 2000
    alpha: float = 0.05
    assumption_alpha: float = 0.05
    seed: int = 42
    n_pc: int = 5
    k_vowel: tuple[int, ...] = (2, 3, 4, 5, 6)
    k_cv: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    k_speaker: tuple[int, ...] = (2, 3, 4)
    pairs: str = "e-ɛ,o-ø,y-u"

    def pair_list(self) -> list[tuple[str, str]]:
        """(a, b) for each "a-b" of ``pairs``."""
        return [tuple(p.split("-", 1)) for p in self.pairs.split(",") if "-" in p]
