"""Pair comparators: each is one boolean column saying whether a pair changed.

A comparator sees a row with ``t_`` and ``q_`` columns of both sides. Registering one is enough to
have it reported: the difference table is generated from the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.compat import Compat
from annodelta.functions.sequence import protein_changed, reverse_complement_upper

Changed = Callable[[float, Compat], Column]


@dataclass(frozen=True)
class Comparator:
    """``name`` is the configuration key, ``label`` and ``order_key`` describe the reported row."""

    name: str
    grain: str  # region, transcript or gene
    label: str
    order_key: int
    changed: Changed
    needs_sequence: bool = False
    only_type: str | None = None


REGISTRY: dict[tuple[str, str], Comparator] = {}


def comparator(name: str, grain: str, label: str, order_key: int, **options):
    """Register a function (threshold, compat) -> boolean Column."""
    def register(fn: Changed) -> Changed:
        REGISTRY[grain, name] = Comparator(name, grain, label, order_key, fn, **options)
        return fn

    return register


def of_grain(grain: str) -> list[Comparator]:
    return sorted((c for (g, _), c in REGISTRY.items() if g == grain), key=lambda c: c.order_key)


def _apart(column: str, threshold: float) -> Column:
    return F.abs(F.col(f"t_{column}") - F.col(f"q_{column}")) > threshold


def _length_apart(threshold: float) -> Column:
    return F.abs((F.col("t_end") - F.col("t_start")) - (F.col("q_end") - F.col("q_start"))) > threshold


@comparator("length", "region", "length", 300)
def region_length(threshold: float, compat: Compat) -> Column:
    return _length_apart(threshold)


@comparator("start", "region", "start", 310)
def region_start(threshold: float, compat: Compat) -> Column:
    return _apart("start", threshold)


@comparator("stop", "region", "stop", 320)
def region_stop(threshold: float, compat: Compat) -> Column:
    return _apart("end", threshold)


@comparator("sequence", "region", "seq", 330, needs_sequence=True)
def region_sequence(threshold: float, compat: Compat) -> Column:
    """Different length, or different text as read forward on both sides."""
    return _length_apart(0) | F.coalesce(F.col("t_sequence") != F.col("q_sequence"), F.lit(False))


@comparator("same_protein", "region", "protein", 340, needs_sequence=True, only_type=C.CDS)
def region_protein(threshold: float, compat: Compat) -> Column:
    def read(p: str) -> Column:
        text = F.col(p + "sequence")
        return F.when(F.col(p + "fwd"), text).otherwise(reverse_complement_upper(text))

    return _length_apart(0) | F.coalesce(protein_changed(read("t_"), read("q_"), compat.skip_last_codon), F.lit(False))


@comparator("transcript_start", "transcript", "start", 100)
def transcript_start(threshold: float, compat: Compat) -> Column:
    return _apart("start", threshold)


@comparator("transcript_stop", "transcript", "stop", 110)
def transcript_stop(threshold: float, compat: Compat) -> Column:
    return _apart("end", threshold)


@comparator("transcript_length", "transcript", "length", 150)
def transcript_length(threshold: float, compat: Compat) -> Column:
    return _length_apart(threshold)


@comparator("transcript_strand", "transcript", "strand", 160)
def transcript_strand(threshold: float, compat: Compat) -> Column:
    return F.col("t_fwd") != F.col("q_fwd")


@comparator("transcript_biotype", "transcript", "biotype", 170)
def transcript_biotype(threshold: float, compat: Compat) -> Column:
    """Different biotypes, unless either side is a lifted placeholder."""
    lifted = (F.col("t_biotype") == C.LIFTED_BIOTYPE) | (F.col("q_biotype") == C.LIFTED_BIOTYPE)
    return (F.col("t_biotype") != F.col("q_biotype")) & ~lifted


@comparator("gene_start", "gene", "start", 30)
def gene_start(threshold: float, compat: Compat) -> Column:
    return _apart("start", threshold)


@comparator("gene_stop", "gene", "stop", 40)
def gene_stop(threshold: float, compat: Compat) -> Column:
    return _apart("end", threshold)


@comparator("gene_strand", "gene", "strand", 50)
def gene_strand(threshold: float, compat: Compat) -> Column:
    return F.col("t_fwd") != F.col("q_fwd")


@comparator("gene_length", "gene", "length", 70)
def gene_length(threshold: float, compat: Compat) -> Column:
    return _length_apart(threshold)


@comparator("gene_contig", "gene", "contig", 80)
def gene_contig(threshold: float, compat: Compat) -> Column:
    return F.col("t_contig") != F.col("q_contig")
