"""Frozen parameters of every stage, with their checks."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed value: terms that slang and typo rules leave alone.
PROTECTED_TERMS = ("kw", "ori", "original", "palsu", "replika", "imitasi", "hdc", "bukan ori", "sesuai deskripsi")


@dataclass(frozen=True)
class CleanConfig:
    min_review_length: int = 2
    fragment_separator: str = " | "
    unicode_nfkc: bool = True
    aspect_max_words: int = 3
    aspect_min_files: int = 3
    phrase_min_words: int = 3
    phrase_min_files: int = 10
    timezone: str = "Asia/Jakarta"
    strong_rate: float = 0.90
    weak_rate: float = 0.30
    masked_rate: float = 0.05
    cooccurrence: float = 0.80
    max_files_without_review: float = 0.05
    technical_needs_time: bool = True
    exclude_duplicate_files: bool = False
    product_thresholds: tuple[int, ...] = (3, 5, 10)
    samples: int = 5

    def __post_init__(self) -> None:
        if self.min_review_length < 1 or self.samples < 1 or not self.fragment_separator:
            raise ValueError("lengths, samples and the separator must be positive")
        for rate in (self.strong_rate, self.weak_rate, self.masked_rate, self.cooccurrence, self.max_files_without_review):
            if not 0 <= rate <= 1:
                raise ValueError("rates lie between 0 and 1")
        if self.weak_rate > self.strong_rate:
            raise ValueError("the weak rate is above the strong one")


@dataclass(frozen=True)
class SequenceConfig:
    min_reviews: int = 3
    sum_tolerance: float = 1e-4
    epsilon: float = 1e-6
    observation: str = "prob"
    reference: str = "p_netral"

    def __post_init__(self) -> None:
        if self.min_reviews < 2:
            raise ValueError("a sequence needs two reviews at least")
        if self.observation not in ("prob", "logit", "alr", "clr"):
            raise ValueError(f"unknown observation {self.observation!r}")


@dataclass(frozen=True)
class HmmConfig:
    states: int = 2
    iterations: int = 200
    tolerance: float = 1e-4
    least_variance: float = 1e-3
    first_variance: float = 0.04
    restarts: int = 10
    seed: int = 42

    def __post_init__(self) -> None:
        if self.states < 2 or self.iterations < 1 or self.restarts < 1:
            raise ValueError("states >= 2, iterations >= 1 and restarts >= 1")
        if self.least_variance <= 0 or self.first_variance <= 0 or self.tolerance < 0:
            raise ValueError("variances and the tolerance must be positive")


@dataclass(frozen=True)
class LexiconConfig:
    window: int = 10
    min_count: int = 2
    min_token_frequency: int = 2
    iterations: int = 50
    confidence: float = 0.95

    def __post_init__(self) -> None:
        if self.window < 1 or self.iterations < 1 or not 0 < self.confidence < 1:
            raise ValueError("window, iterations and confidence out of range")
