"""Gene and transcript mapping by structure, filtering and validation, file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import Annotation
from annodelta.operators import genome as G
from annodelta.operators import origins, signature, similarity
from annodelta.session import cut_lineage
from annodelta.sinks import writers
from annodelta.sources import fasta, gtf, tables


def allowed_types(names: list[str] | None) -> list[str] | None:
    """Canonical feature types of an option list; unknown names are skipped, an empty list means all."""
    known = [C.canonical_type(n) for n in names or []]
    return sorted({k for k in known if k}) or None


def single_region_sequences(annotation: Annotation, genome: DataFrame, types: list[str] | None) -> DataFrame:
    """Strand-oriented sequence of the transcripts whose signature is one region."""
    spans = signature.single_region_spans(annotation.features, types)
    fetched = G.fetch_spans(spans, genome, ["gene_id", "transcript_id"])
    return fetched.select("contig", "transcript_id", G.on_strand(F.col("sequence"), F.col("fwd")).alias("sequence"))


def _sides(spark: SparkSession, target_gtf: str, query_gtf: str) -> tuple[Annotation, Annotation]:
    return gtf.read_annotation(spark, target_gtf, introns=False), gtf.read_annotation(spark, query_gtf, introns=False)


def _sequences(spark, sides, fastas, fais, types, use_homology):
    if not use_homology:
        return None, None
    return tuple(
        single_region_sequences(a, fasta.read_genome(spark, f, i), types) for a, f, i in zip(sides, fastas, fais)
    )


def map_genes(
    spark: SparkSession, target_gtf: str, query_gtf: str, out: str, types: list[str] | None = None,
    target_fasta: str | None = None, query_fasta: str | None = None,
    target_fai: str | None = None, query_fai: str | None = None, use_homology: bool = False, cutoff: float = 1.0,
) -> None:
    """Gene mapping to ``out``, unmapped protein coding genes to ``out``.unmapped."""
    target, query = _sides(spark, target_gtf, query_gtf)
    types = allowed_types(types)
    t_seq, q_seq = _sequences(
        spark, (target, query), (target_fasta, query_fasta), (target_fai, query_fai), types, use_homology
    )
    pairs = signature.map_genes(target, query, types, t_seq, q_seq, cutoff=cutoff)
    writers.write_mapping(pairs, out)
    written = origins.parse_mapping_rows(tables.read_mapping(spark, out))
    writers.write_unmapped(
        signature.unmapped_genes(target, written, "target").unionByName(signature.unmapped_genes(query, written, "query")),
        out + ".unmapped",
    )


def map_transcripts(
    spark: SparkSession, target_gtf: str, query_gtf: str, mapping: str, out: str, types: list[str] | None = None,
    target_fasta: str | None = None, query_fasta: str | None = None,
    target_fai: str | None = None, query_fai: str | None = None, use_homology: bool = False, cutoff: float = 1.0,
) -> None:
    """All transcript pairs of equal (below a ``cutoff`` of 1, of similar) structure inside the gene pairs of a mapping file."""
    target, query = _sides(spark, target_gtf, query_gtf)
    types = allowed_types(types)
    t_seq, q_seq = _sequences(
        spark, (target, query), (target_fasta, query_fasta), (target_fai, query_fai), types, use_homology
    )
    pairs = origins.resolve_mapping(
        origins.parse_mapping_rows(tables.read_mapping(spark, mapping)), target.genes, query.genes
    )
    t_sig, q_sig = (signature.signature_digests(x.features, types, seq) for x, seq in ((target, t_seq), (query, q_seq)))
    if cutoff < 1.0:
        t_sig = similarity.as_query_signatures(t_sig, similarity.similar_signatures(
            t_sig, q_sig, target.features, query.features, cutoff, types, t_seq is not None))
    matches = signature.map_transcripts(pairs, t_sig, q_sig)
    writers.write_mapping(matches, out)
    written = origins.parse_mapping_rows(tables.read_mapping(spark, out))
    writers.write_unmapped(
        signature.unmapped_transcripts(pairs, target.transcripts, written, "target").unionByName(
            signature.unmapped_transcripts(pairs, query.transcripts, written, "query")),
        out + ".unmapped",
    )


def filter_mapping(spark: SparkSession, mapping: str, out: str, wanted: list[str], require_all: bool) -> None:
    writers.write_tsv(origins.filter_by_origins(tables.read_mapping(spark, mapping), wanted, require_all), out)


def validated_pairs(mapping: DataFrame, target: Annotation, query: Annotation, target_genome: DataFrame, query_genome: DataFrame) -> DataFrame:
    """Mapped transcript pairs known to both releases, with ``same`` telling equal genomic text."""
    pairs = origins.resolve_mapping(origins.parse_mapping_rows(mapping), target.genes, query.genes)
    located = pairs
    for side, annotation in (("target", target), ("query", query)):
        p = side[0]
        located = located.join(annotation.transcripts.select(
            "contig", F.col("transcript_id").alias(f"{side}_transcript_id"), F.col("gene_id").alias(f"{side}_gene_id"),
            F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"),
        ), ["contig", f"{side}_transcript_id", f"{side}_gene_id"])
    keys = ["target_gene_id", "query_gene_id", "target_transcript_id", "query_transcript_id"]
    compared = G.compare_spans(
        located.select("contig", *keys, "t_start", "t_end", "q_start", "q_end"), target_genome, query_genome, keys
    )
    return compared.select(*keys, F.col("t_sequence").eqNullSafe(F.col("q_sequence")).alias("same"))


def validate_mapping(
    spark: SparkSession, target_gtf: str, query_gtf: str, mapping: str, target_fasta: str, query_fasta: str, out: str,
    target_fai: str | None = None, query_fai: str | None = None,
) -> None:
    target, query = _sides(spark, target_gtf, query_gtf)
    writers.write_validation(validated_pairs(
        tables.read_mapping(spark, mapping), target, query,
        fasta.read_genome(spark, target_fasta, target_fai), fasta.read_genome(spark, query_fasta, query_fai),
    ), out)
