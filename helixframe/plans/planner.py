"""Which way a training goes: by kernel matrix or explicit representation, in one task or distributed."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.kernels import Mixture, PairSpec, Spec

#: Samples up to which kernel matrices are used, feature-space size below which representations are, samples above which linear problems take the fast solver.
SAMPLES_FOR_MATRIX = 5_000
FEATURES_FOR_REPRESENTATION = 100_000
SAMPLES_FOR_FAST = 1_000


@dataclass(frozen=True)
class TrainPlan:
    method: str
    solver: str
    reason: str


def choose_method(spec: Spec | Mixture | PairSpec, samples: int, explicit: str = "auto", probability: bool = False) -> TrainPlan:
    """method: matrix or representation; solver: task (one machine holds the kernel) or distributed."""
    if explicit not in ("auto", "yes", "no"):
        raise ValueError("explicit is auto, yes or no")
    only_matrix = isinstance(spec, PairSpec) or (isinstance(spec, Spec) and (spec.dist_weight is not None or spec.r != 1))
    if only_matrix and explicit == "yes":
        raise ValueError("this kernel has no explicit representation")
    if explicit == "no" or only_matrix:
        return TrainPlan("matrix", "task", "asked for" if explicit == "no" else "no explicit representation")
    dimension = max(s.dimension() for _, s in spec.parts) if isinstance(spec, Mixture) else spec.dimension()
    if explicit == "yes" or samples > SAMPLES_FOR_MATRIX or dimension < FEATURES_FOR_REPRESENTATION:
        fast = samples > SAMPLES_FOR_FAST and not probability
        return TrainPlan("representation", "distributed" if fast else "task", "many samples" if samples > SAMPLES_FOR_MATRIX else "small feature space" if explicit == "auto" else "asked for")
    return TrainPlan("matrix", "task", "large feature space, few samples")
