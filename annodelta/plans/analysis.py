"""The full comparison: match transcripts, compare them, report every difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta.annotation import Annotation, fill_coordinates
from annodelta.compat import Compat
from annodelta.config import Comparison, load_comparison
from annodelta.operators import difference, fallback, genome, matching
from annodelta.session import cut_lineage
from annodelta.sinks import writers
from annodelta.sources import fasta, gtf

# Fixed value: suffix of the report of sequence matches, named after the customary aligner.
SEQUENCE_REPORT_SUFFIX = ".minimap2"


def match(target: Annotation, query: Annotation, use_strand: bool = True) -> DataFrame:
    """One-to-one matches of the transcripts of overlapping loci."""
    located = [fill_coordinates(a.transcripts, a.features).where("start is not null") for a in (target, query)]
    return matching.match_transcripts(*located, target.features, query.features, use_strand)


def search_leftovers(
    target: Annotation, query: Annotation, matches: DataFrame, target_genome: DataFrame, query_genome: DataFrame,
    coding_only: bool = False,
) -> DataFrame:
    """Matches of the remaining transcripts by sequence, each within its contig."""
    def sequences(a: Annotation, g: DataFrame, side: str) -> DataFrame:
        rest = matching.unmatched(a.transcripts, matches, side)
        features = a.features.join(rest.select("contig", "transcript_id"), ["contig", "transcript_id"], "left_semi")
        spliced = genome.spliced_sequences(features, g, coding_only)
        return spliced.select("contig", F.concat_ws("\t", "contig", "transcript_id").alias("id"), "sequence")

    found = fallback.map_by_alignment(
        sequences(target, target_genome, "target"), sequences(query, query_genome, "query"), ["contig"]
    )
    t, q = F.split("target_id", "\t"), F.split("query_id", "\t")
    return found.select(
        t[0].alias("contig"), t[1].alias("target_transcript_id"), q[1].alias("query_transcript_id"), *fallback.MEASURES
    )


def analyse(
    spark: SparkSession, target_gtf: str, query_gtf: str, config: str | Comparison, out: str,
    fasta_path: str | None = None, fai: str | None = None, use_strand: bool = True, coding_only: bool = False,
    compat: Compat = Compat(),
) -> None:
    """Differences of overlap matches to ``out``, of sequence matches beside it, and unmapped lists.

    Reports have the contigs in the order of the target file.
    """
    target, query = gtf.read_annotation(spark, target_gtf), gtf.read_annotation(spark, query_gtf)
    settings = load_comparison(config) if isinstance(config, str) else config
    text = fasta.read_genome(spark, fasta_path, fai) if fasta_path else None
    contigs = cut_lineage(gtf.contig_order(spark, target_gtf))
    matches = cut_lineage(match(target, query, use_strand))
    used = matches
    if text is not None:
        by_sequence = cut_lineage(search_leftovers(target, query, matches, text, text, coding_only))
        pairs = difference.transcript_pairs(by_sequence, target, query, settings)
        writers.write_differences(
            difference.difference_table(pairs, target, query, settings, text, text, compat), out + SEQUENCE_REPORT_SUFFIX, compat, contigs
        )
        columns = ["contig", "target_transcript_id", "query_transcript_id"]
        used = matches.select(*columns).unionByName(by_sequence.select(*columns))
    pairs = difference.transcript_pairs(matches, target, query, settings)
    writers.write_differences(difference.difference_table(pairs, target, query, settings, text, text, compat), out, compat, contigs)
    for side, annotation in (("target", target), ("query", query)):
        name = {"target": "targets", "query": "queries"}[side]
        writers.write_tsv(
            matching.unmatched(annotation.transcripts, used, side).select("contig", "transcript_id"),
            f"{out}.unmapped_{name}", header=False,
        )


def unmapped_children(annotation: Annotation, matches: DataFrame, side: str) -> DataFrame:
    """Unmatched transcripts with all their child rows (source, transcript_id, feature, start, stop)."""
    rest = matching.unmatched(annotation.transcripts, matches, side).select("contig", "transcript_id", "source")
    return rest.join(annotation.features, ["contig", "transcript_id"]).select(
        "source", "transcript_id", F.col("type").alias("feature"), "start", F.col("end").alias("stop")
    )
