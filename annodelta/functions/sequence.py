"""Nucleotide expressions. All of them are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annodelta.constants import CODON_TABLE


def reverse_complement(bases: Column) -> Column:
    """Reverse complement keeping the letter case; anything but a base becomes N."""
    return F.translate(F.regexp_replace(F.reverse(bases), "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca")


def reverse_complement_upper(bases: Column) -> Column:
    """Reverse complement of upper-case bases only; lower case becomes N as well."""
    return F.translate(F.regexp_replace(F.reverse(bases), "[^ACGT]", "N"), "ACGT", "TGCA")


STOPS = [codon for codon, acid in CODON_TABLE.items() if acid == "*"]


def _codons(bases: Column) -> Column:
    return F.regexp_extract_all(bases, F.lit("(?s)(...)"), F.lit(1))


def _amino_acid(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for entry in CODON_TABLE.items() for x in entry])
    return F.coalesce(F.try_element_at(table, codon), F.lit("X"))


def _amino_acids(bases: Column) -> Column:
    return F.transform(_codons(bases), _amino_acid)


def translate_codons(bases: Column) -> Column:
    """Protein of a coding sequence; unknown codons give X, a trailing partial codon nothing."""
    return F.array_join(_amino_acids(bases), "")


def protein_verdicts(target: Column, query: Column) -> Column:
    """A letter per whole codon of two different sequences of one length: d different, s both a stop, = equal otherwise.

    Equal codons need no look-up of what they stand for.
    """
    def verdict(a: Column, b: Column) -> Column:
        same = F.when(a.isin(STOPS), "s").otherwise("=")
        return F.when(a == b, same).when(_amino_acid(a) != _amino_acid(b), "d").otherwise(same)

    return F.when((F.length(target) == F.length(query)) & (target != query),
                  F.array_join(F.zip_with(_codons(target), _codons(query), verdict), ""))


def protein_changed(target: Column, query: Column, skip_last_codon: bool = True, verdicts: Column | None = None) -> Column:
    """Whether two coding sequences differ before their first common stop codon.

    Sequences of unequal length differ. With ``skip_last_codon`` the last codon is not looked at
    when the length is a multiple of three. ``verdicts`` are those of the pair, where they are known already.
    """
    used = F.length(target) - 1 if skip_last_codon else F.length(target)
    letters = F.substring(protein_verdicts(target, query) if verdicts is None else verdicts, F.lit(1), F.floor(used / 3).cast("int"))
    return (
        F.when(F.length(target) != F.length(query), F.lit(True))
        .when(target == query, F.lit(False))
        .otherwise(letters.rlike("^=*d"))
    )
