"""Switches between corrected behaviour and historic output quirks."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    """Each flag reproduces one historic quirk; the defaults give the corrected result.

    ``skip_last_codon`` and ``narrow_impact_keys`` only choose between two conventions, and
    default to the historic one because existing difference tables follow it.
    """

    reverse_introns_unpaired: bool = False
    none_row_short: bool = False
    skip_last_codon: bool = True
    narrow_impact_keys: bool = True
