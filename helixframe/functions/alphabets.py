"""Sequence alphabets: which characters may be part of a pattern."""

from __future__ import annotations

from dataclasses import dataclass

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Alphabet:
    """letters: valid characters in sort order; size: what feature-space dimensions count; pairs: complements, for DNA and RNA."""

    name: str
    letters: str
    size: int
    pairs: tuple[str, str] | None = None

    @property
    def char_class(self) -> str:
        """The letters as a regular-expression class."""
        return "[" + "".join("\\" + c if c in "-+]^\\" else c for c in self.letters) + "]"


#: The letters of the exact and the IUPAC alphabets.
DNA = Alphabet("dna", "ACGT", 4, ("ACGT", "TGCA"))
RNA = Alphabet("rna", "ACGU", 4, ("ACGU", "UGCA"))
AA = Alphabet("aa", "ACDEFGHIKLMNPQRSTUVWY", 21)
DNA_IUPAC = Alphabet("dna_iupac", "ACGTMRWSYKVHDBN-+", 15, ("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"))
RNA_IUPAC = Alphabet("rna_iupac", "ACGUMRWSYKVHDBN-+", 15, ("ACGUMRWSYKVHDBN", "UGCAKYWSRMBDHVN"))
ALPHABETS = {a.name: a for a in (DNA, RNA, AA, DNA_IUPAC, RNA_IUPAC)}


def alphabet(kind: str, exact: bool = True) -> Alphabet:
    """kind: dna, rna or aa. Amino acids are always exact; IUPAC letters stand for themselves."""
    if kind not in ("dna", "rna", "aa"):
        raise ValueError(f"unknown sequence kind {kind!r}")
    return ALPHABETS[kind if exact or kind == "aa" else f"{kind}_iupac"]
