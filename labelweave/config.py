"""Settings, defaults and the errors raised for bad ones."""

from __future__ import annotations

import math
import secrets
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

import numpy as np


class InvalidInput(ValueError):
    """Settings or data that must not be trained on, stored or scored."""


class NotFound(LookupError):
    """An id that names no stored row."""


# The wire names and limits every client of these jobs relies on.
TF_SCHEMES = (
    "binary",
    "raw_count",
    "normalization",
    "double_normalization_half",
    "double_normalization_variable",
)
IDF_SCHEMES = ("base", "smooth", "maximum", "probabilistic")
SAMPLINGS = ("stratified", "random")
METRICS = ("macro_f1", "balanced_accuracy", "matthews_correlation")
CLASSIFIERS = ("nearest_centroid",)
SCORE_USAGE = "held-out selection scores"
MAX_PAGES = 32_767


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise InvalidInput(f"unknown {what} {value!r}; expected one of {', '.join(allowed)}")


def _from_mapping(cls, values: Mapping[str, Any] | None):
    """Build a settings class from a JSON object, rejecting unknown keys."""
    values = dict(values or {})
    unknown = set(values) - {f.name for f in fields(cls)}
    if unknown:
        raise InvalidInput(f"unknown field(s) for {cls.__name__}: {', '.join(sorted(unknown))}")
    return cls(**values)


@dataclass(frozen=True)
class TfIdfSettings:
    tf_scheme: str = "raw_count"
    idf_scheme: str = "base"
    double_normalization_k: float = 0.5

    def __post_init__(self) -> None:
        _one_of(self.tf_scheme, TF_SCHEMES, "TF scheme")
        _one_of(self.idf_scheme, IDF_SCHEMES, "IDF scheme")
        k = self.double_normalization_k
        # Checked whatever the scheme, so a bad k never lies dormant in saved settings.
        if not math.isfinite(k) or not 0.0 <= k <= 1.0:
            raise InvalidInput("the weight k of double normalization has to lie between 0 and 1")


@dataclass(frozen=True)
class SplitSettings:
    ratio: float = 0.8
    repetitions: int = 5
    sampling: str = "stratified"

    def __post_init__(self) -> None:
        _one_of(self.sampling, SAMPLINGS, "sampling")
        # Sizes are computed in 32-bit arithmetic, so keep the ratio the job really uses.
        object.__setattr__(self, "ratio", float(np.float32(self.ratio)))

    def check_trainable(self) -> None:
        """An evaluated run needs something on both sides of every split."""
        if not (math.isfinite(self.ratio) and 0.0 < self.ratio < 1.0 and self.repetitions > 0):
            raise InvalidInput(
                "to judge a run, its train ratio has to lie between 0 and 1 and its splits number 1 or more"
            )

    def check_partitionable(self) -> None:
        """The free-standing random partition accepts any finite ratio and clamps it."""
        if not math.isfinite(self.ratio):
            raise InvalidInput("the train ratio of a split is not a finite number")
        if self.repetitions <= 0:
            raise InvalidInput("the number of splits has to be 1 or more")


ONCE = SplitSettings(repetitions=1)


@dataclass(frozen=True)
class TrainingConfig:
    classifier: str = "nearest_centroid"
    split: SplitSettings = field(default_factory=SplitSettings)
    tf_idf: TfIdfSettings = field(default_factory=TfIdfSettings)
    evaluation_strategy: str = "macro_f1"
    seed: int | None = None

    def __post_init__(self) -> None:
        _one_of(self.classifier, CLASSIFIERS, "classifier")
        _one_of(self.evaluation_strategy, METRICS, "evaluation strategy")
        if self.seed is not None and not 0 <= self.seed < 2**64:
            raise InvalidInput("seed must fit an unsigned 64-bit integer")

    @classmethod
    def from_request(cls, request: Mapping[str, Any]) -> TrainingConfig:
        """Settings part of a training request, i.e. its JSON object without the documents."""
        values = dict(request)
        values.pop("documents", None)
        if "classifier" not in values:
            raise InvalidInput("classifier is required")
        for name, kind in (("split", SplitSettings), ("tf_idf", TfIdfSettings)):
            if name in values:
                values[name] = _from_mapping(kind, values[name])
        return _from_mapping(cls, values)

    def with_seed(self) -> TrainingConfig:
        """The same settings with a seed: the given one, or a fresh one to report and reuse."""
        if self.seed is not None:
            return self
        return TrainingConfig(
            self.classifier,
            self.split,
            self.tf_idf,
            self.evaluation_strategy,
            secrets.randbits(64),
        )

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)
