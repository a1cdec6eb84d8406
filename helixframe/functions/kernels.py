"""Kernel specifications: frozen parameters that operators turn into plans."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from .alphabets import Alphabet, alphabet

EPS = 2.220446049250313e-16


def lin_weight(sigma: float = 1.0) -> Callable[[int], float]:
    return lambda d: max(1 - abs(d) / sigma, 0.0)


def exp_weight(sigma: float = 1.0) -> Callable[[int], float]:
    return lambda d: math.exp(-abs(d) / sigma)


def gauss_weight(sigma: float = 1.0) -> Callable[[int], float]:
    return lambda d: math.exp(-d * d / sigma)


def swd_weight() -> Callable[[int], float]:
    """The weight of the shifted weighted-degree kernel."""
    return lambda d: 1 / (2 * (abs(d) + 1))


@dataclass(frozen=True)
class Spec:
    """What all pattern kernels share.

    kind: dna, rna, aa. dist_weight: None, a tuple of weights by distance, or a function of the distance; the
    single weight (1,) compares patterns at equal positions. annotated appends the annotation of the window.
    """

    kind: str = "dna"
    k: int = 3
    r: int = 1
    normalized: bool = True
    exact: bool = True
    ignore_lower: bool = True
    presence: bool = False
    annotated: bool = False
    rev_complement: bool = False
    dist_weight: tuple[float, ...] | Callable[[int], float] | None = None

    name = "spectrum"

    @property
    def letters(self) -> Alphabet:
        return alphabet(self.kind, self.exact)

    def __post_init__(self) -> None:
        if self.k < 1 or self.r < 1:
            raise ValueError("k and r must be at least 1")
        if self.presence and self.dist_weight is not None:
            raise ValueError("presence can't be combined with distance weights")
        if self.annotated and self.dist_weight is not None:
            raise ValueError("annotation can't be combined with distance weights")
        if self.rev_complement and self.letters.pairs is None:
            raise ValueError("reverse complements are of DNA and RNA only")
        if self.k > self.k_limit():
            raise ValueError(f"k is at most {self.k_limit()} here")

    def k_limit(self) -> int:
        return {"aa": 8 if self.annotated else 14}.get(self.kind, (12 if self.annotated else 30) if self.exact else (8 if self.annotated else 15))

    def widths(self) -> tuple[int, ...]:
        """Lengths of the windows looked at."""
        return (self.k,)

    def significant(self) -> int:
        """Positions of a pattern that carry its weight."""
        return self.k

    def dimension(self, annotation_letters: int = 0) -> int:
        """Size of the feature space."""
        return self.letters.size**self.k * (annotation_letters**self.k if self.annotated else 1)

    def parameters(self) -> dict:
        return asdict(self)

    def weights(self, longest: int) -> tuple[float, ...]:
        """Weights by distance 0..longest, without the trailing ones that vanish; a function is called here, on the driver."""
        w = self.dist_weight
        values = tuple(float(w(d)) for d in range(longest + 1)) if callable(w) else tuple(map(float, w or ()))
        while values and abs(values[-1]) <= EPS:
            values = values[:-1]
        return values

    def __str__(self) -> str:
        flags = [f"{k}={'TRUE' if v is True else 'FALSE' if v is False else v}" for k, v in self.parameters().items() if k not in ("kind", "dist_weight") and v != type(self).__dataclass_fields__[k].default]
        return f"{self.name}(" + ", ".join([f"k={self.k}", *(f for f in flags if not f.startswith("k="))]) + ")"


@dataclass(frozen=True)
class SpectrumSpec(Spec):
    name = "spectrum"


@dataclass(frozen=True)
class MismatchSpec(Spec):
    """Every window counts for all k-mers at a Hamming distance of at most m."""

    m: int = 1
    name = "mismatch"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 1 <= self.m < self.k:
            raise ValueError("m must be at least 1 and less than k")
        if self.annotated or self.dist_weight is not None or self.rev_complement:
            raise ValueError("the mismatch kernel has no annotation, positions or reverse complements")

    def k_limit(self) -> int:
        return 15 if self.kind != "aa" and self.exact else 7


@dataclass(frozen=True)
class GappySpec(Spec):
    """Two k-mers with 0 to m positions between them."""

    k: int = 1
    m: int = 1
    name = "gappy_pair"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 1 <= self.m <= 30:
            raise ValueError("m must be from 1 to 30")

    def k_limit(self) -> int:
        return {"aa": 2 if self.annotated else 6}.get(self.kind, (4 if self.annotated else 10) if self.exact else (4 if self.annotated else 7))

    def widths(self) -> tuple[int, ...]:
        return tuple(2 * self.k + g for g in range(self.m + 1))

    def significant(self) -> int:
        return 2 * self.k

    def dimension(self, annotation_letters: int = 0) -> int:
        return (self.m + 1) * self.letters.size ** (2 * self.k) * (annotation_letters ** (2 * self.k) if self.annotated else 1)


def motif_elements(motif: str) -> list[str]:
    """The elements of a motif: letters, `.`, `[CT]` and `[^CT]`; a malformed motif raises."""
    out, at = [], 0
    while at < len(motif):
        if motif[at] != "[":
            if motif[at] in "]^":
                raise ValueError(f"misplaced {motif[at]!r} in motif {motif!r}")
            out.append(motif[at])
            at += 1
            continue
        end = motif.find("]", at)
        body = motif[at + 1 : end].removeprefix("^") if end > 0 else ""
        if not body or set(body) & set("[^.") or len(set(body)) < len(body):
            raise ValueError(f"malformed group in motif {motif!r}")
        out.append(motif[at : end + 1])
        at = end + 1
    if not out:
        raise ValueError("an empty motif")
    return out


@dataclass(frozen=True)
class MotifSpec(Spec):
    """Occurrences of given motifs at every start, overlaps included."""

    motifs: tuple[str, ...] = field(default=())
    name = "motif"

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "motifs", tuple(m.upper() for m in self.motifs))
        if not self.motifs or len(set(self.motifs)) < len(self.motifs):
            raise ValueError("motifs must be given and differ")
        if self.rev_complement:
            raise ValueError("the motif kernel has no reverse complements")
        for m in self.motifs:
            for e in motif_elements(m):
                if not set(e) - set("[^].") <= set(self.letters.letters):
                    raise ValueError(f"{e!r} in motif {m!r} isn't of the alphabet")

    def pattern(self, motif: str) -> str:
        """The motif as a regular expression over the alphabet."""
        letters = self.letters.letters
        one = {".": self.letters.char_class}
        group = lambda e: "[" + "".join(c for c in letters if (c in e) != e.startswith("[^")) + "]"
        return "".join(one.get(e) or (group(e) if e[0] == "[" else e) for e in motif_elements(motif))

    def widths(self) -> tuple[int, ...]:
        return tuple(len(motif_elements(m)) for m in self.motifs)

    def dimension(self, annotation_letters: int = 0) -> int:
        return len(self.motifs) * (annotation_letters ** max(self.widths()) if self.annotated else 1)


@dataclass(frozen=True)
class Mixture:
    """A weighted sum of kernels; components with weight 0 are left out."""

    parts: tuple[tuple[float, Spec], ...]

    @staticmethod
    def by_k(spec: Spec, coefficients: tuple[float, ...]) -> Mixture:
        """Kernels with k = 1, 2, ... and their coefficients: mixed spectrum, weighted degree or shifted weighted degree."""
        return Mixture(tuple((c, replace(spec, k=i)) for i, c in enumerate(coefficients, 1) if c))


@dataclass(frozen=True)
class PairSpec:
    """Similarity of pairs of sequences from the kernel of single ones: mean, or tensor product of pairs (tppk)."""

    single: Spec
    pairing: str = "mean"

    def __post_init__(self) -> None:
        if self.pairing not in ("mean", "tppk"):
            raise ValueError("pairing is mean or tppk")
