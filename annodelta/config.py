"""Comparison settings, read on the driver from a small JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from annodelta import constants as C

# Names of the comparators a configuration can enable.
REGION_COMPARATORS = ["start", "stop", "length", "sequence", "same_protein"]
TRANSCRIPT_COMPARATORS = [
    "transcript_start", "transcript_stop", "transcript_length", "transcript_strand", "transcript_biotype",
]


@dataclass(frozen=True)
class Comparison:
    """What to compare: enabled names, thresholds, impacts and transcript biotypes let through."""

    comparators: frozenset[str] = frozenset(REGION_COMPARATORS + TRANSCRIPT_COMPARATORS)
    feature_types: tuple[str, ...] = tuple(C.FEATURE_TYPES)
    thresholds: dict[str, float] = field(default_factory=dict)
    impacts: dict[str, str] = field(default_factory=dict)
    allowed_biotypes: tuple[str, ...] = ()

    def enabled(self, name: str) -> bool:
        return name in self.comparators or name in self.feature_types

    def threshold(self, name: str) -> float:
        return self.thresholds.get(name, 0.0)


def load_comparison(path: str) -> Comparison:
    with open(path, encoding="utf-8") as handle:
        return parse_comparison(json.load(handle))


def parse_comparison(raw: dict) -> Comparison:
    """Unknown comparator names and feature types are errors; types accept any known spelling."""
    thresholds: dict[str, float] = {}
    impacts: dict[str, str] = {}

    def settings(name: str, entry: dict) -> bool:
        if entry.get("threshold") is not None:
            thresholds[name] = float(entry["threshold"])
        if entry.get("impact") is not None:
            level = str(entry["impact"]).upper()
            if level not in C.IMPACTS:
                raise ValueError(f"unknown impact {entry['impact']!r} for {name}")
            impacts[name] = level
        return bool(entry.get("enabled", False))

    known = set(REGION_COMPARATORS + TRANSCRIPT_COMPARATORS)
    comparators = set()
    for name, entry in (raw.get("features") or {}).items():
        if name not in known:
            raise ValueError(f"unknown comparator {name!r}")
        if settings(name, entry):
            comparators.add(name)
    types = set()
    for name, entry in (raw.get("transcript_features") or {}).items():
        canonical = C.canonical_type(name)
        if canonical is None:
            raise ValueError(f"unknown feature type {name!r}")
        if settings(canonical, entry):
            types.add(canonical)
    return Comparison(
        frozenset(comparators), tuple(t for t in C.FEATURE_TYPES if t in types), thresholds, impacts,
        tuple((raw.get("gene_biotypes") or {}).get("allowed") or ()),
    )
