"""Descriptive modes: statistics, clusters, lifted releases, rewriting, extraction, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import Annotation
from annodelta.functions.text import first_values
from annodelta.operators import genome as G
from annodelta.operators import loci, pairing, profile, statistics
from annodelta.sinks import writers
from annodelta.sources import fasta, gtf, tables


def gtf_statistics(spark: SparkSession, folder: str, out: str, recursive: bool = False) -> None:
    """Counts, histograms and length lists of every annotation file, one sub-folder value per file.

    All files are read in one job; the file name becomes part of the contig key, so equal ids of
    different files stay apart.
    """
    lines = gtf.read_gtf_lines(spark, folder, recursive)
    prefix = F.regexp_replace("file", r"(?i)\.gtf$", "")
    tagged = lines.withColumn("contig", F.concat_ws("\t", prefix, F.col("contig")))
    annotation = gtf.to_annotation(tagged)
    file_of = F.split("contig", "\t")[0].alias("prefix")

    def by_file(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").partitionBy("prefix").option("sep", "\t").option("header", True).csv(f"{out}/{name}")

    by_file(file_counts(annotation, file_of), "global")
    for name, rows, attribute in (
        ("gene_biotypes", annotation.genes, "gene_biotype"), ("transcript_biotypes", annotation.transcripts, "transcript_biotype"),
    ):
        histogram = rows.groupBy(file_of, F.coalesce(attribute, "source").alias("biotype")).agg(F.count(F.lit(1)).alias("count"))
        by_file(histogram.orderBy("prefix", "biotype"), name)
    by_file(statistics.transcripts_per_gene(annotation).select(file_of, "n"), "transcripts_per_gene")
    by_file(statistics.regions_per_transcript(annotation).select(file_of, "n_exon", "n_intron"), "regions_per_transcript")
    by_file(file_lengths(annotation, file_of), "lengths")


def file_counts(annotation: Annotation, file_of) -> DataFrame:
    """(prefix, name, count) of genes, transcripts and every counted type of every file, zeros included."""
    names = [C.GENE, C.TRANSCRIPT, *statistics.COUNTED_TYPES]
    rows = annotation.genes.select(file_of, F.lit(C.GENE).alias("name")).unionByName(
        annotation.transcripts.select(file_of, F.lit(C.TRANSCRIPT).alias("name"))
    ).unionByName(annotation.features.select(file_of, F.col("type").alias("name")))
    counts = rows.groupBy("prefix").agg(*(F.count_if(F.col("name") == name).alias(name) for name in names))
    entries = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("count")) for name in names))
    return counts.select("prefix", F.inline(entries))


def file_lengths(annotation: Annotation, file_of) -> DataFrame:
    size = (F.col("end") - F.col("start") + 1).alias("length")
    return annotation.genes.select(file_of, F.lit(C.GENE).alias("kind"), size).unionByName(
        annotation.transcripts.select(file_of, F.lit(C.TRANSCRIPT).alias("kind"), size)
    ).unionByName(
        annotation.features.where(F.col("type").isin(statistics.MEASURED_TYPES)).select(file_of, F.col("type").alias("kind"), size)
    )


def clique_analysis(spark: SparkSession, target_gtf: str, query_gtf: str, out: str, use_strand: bool = True) -> DataFrame:
    """Cluster statistics to ``out``.csv, unmatched genes to ``out``; returns the statistics."""
    target, query = gtf.read_annotation(spark, target_gtf, introns=False), gtf.read_annotation(spark, query_gtf, introns=False)
    states = loci.gene_states(target.genes, query.genes, use_strand)
    writers.write_tsv(
        states.where(F.col("state") != "EXACT").select("contig", "side", "state", "gene_id"), out, header=False
    )
    summary = loci.clique_statistics(states)
    summary.where(F.col("contig") != "TOTAL").orderBy("contig").write.mode("overwrite").option("header", True).csv(out + ".csv")
    return summary


def lifted_differences(
    spark: SparkSession, query_gtf: str, target_gtf: str, lifted_gtf: str, query_fasta: str, target_fasta: str, out: str,
    query_fai: str | None = None, target_fai: str | None = None,
) -> DataFrame:
    """Id pairs of the plain and the lifted query release, and where they differ."""
    query, target, lifted = (gtf.read_annotation(spark, p, introns=False).genes for p in (query_gtf, target_gtf, lifted_gtf))
    keys = ["contig", "gene_id"]
    normal = pairing.pair_by_id(target, query, keys, "inner")
    pairs = pairing.lifted_pairs(lifted, target)
    still = pairs.where(~F.col("moved")).select("contig", "gene_id", "t_start", "t_end")
    original = query.select("contig", "gene_id", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    missing = still.join(original, keys, "left_anti").select("gene_id")
    compared = G.compare_spans(
        still.join(original, keys), fasta.read_genome(spark, target_fasta, target_fai),
        fasta.read_genome(spark, query_fasta, query_fai), ["gene_id"],
    )
    by_sequence = compared.where(~F.col("t_sequence").eqNullSafe(F.col("q_sequence"))).select("contig", "gene_id")

    def listing(df: DataFrame, suffix: str) -> None:
        writers.write_tsv(df.select(
            "contig", F.col("gene_id").alias("queryGeneId"), F.col("gene_id").alias("targetGeneId")), out + suffix)

    listing(normal, ".normalMapping")
    listing(pairs, ".liftedMapping")
    listing(pairs.where("moved"), ".diffByPosition")
    listing(by_sequence, ".diffBySeq")
    writers.write_tsv(missing, out + ".missingInLifted", header=False)
    overview = pairing.lifted_statistics(query, target, lifted, by_sequence)
    writers.write_tsv(overview.toDF(
        "Chrom", "QueryGenes", "TargetGenes", "LiftedQueryGenes", "1to1Normal", "1to1Lifted", "DiffPos", "DiffSeq"), out)
    return overview


def completed_lines(lines: DataFrame) -> DataFrame:
    """GTF rows in nested order, introns left out, absent transcript coordinates filled from children.

    Rows carry their sort columns: first appearance of the gene, of the transcript, level, file order.
    """
    rows = lines.withColumns({
        "kind": gtf.canonical(F.col("type")),
        "gene_id": gtf.attribute_value(F.col("attribute_text"), "gene_id"),
        "transcript_id": gtf.attribute_value(F.col("attribute_text"), "transcript_id"),
    }).where(F.coalesce("kind", F.lit("")) != C.INTRON)
    genes = rows.groupBy("contig", "gene_id").agg(F.min("ord").alias("gene_ord"))
    transcripts = rows.where("transcript_id is not null").groupBy("contig", "gene_id", "transcript_id").agg(
        F.min("ord").alias("tx_ord"),
        F.min(F.when(~F.col("kind").isin(C.GENE, C.TRANSCRIPT), F.col("start"))).alias("cs"),
        F.max(F.when(~F.col("kind").isin(C.GENE, C.TRANSCRIPT), F.col("end"))).alias("ce"),
    )
    level = F.when(F.col("kind") == C.GENE, 0).when(F.col("kind") == C.TRANSCRIPT, 1).otherwise(2)
    is_transcript = F.col("kind") == C.TRANSCRIPT
    return (
        rows.join(genes, ["contig", "gene_id"]).join(transcripts, ["contig", "gene_id", "transcript_id"], "left")
        .withColumns({
            "level": level,
            "start": F.coalesce("start", F.when(is_transcript, F.col("cs"))),
            "end": F.coalesce("end", F.when(is_transcript, F.col("ce"))),
        })
        .drop("cs", "ce")
    )


def add_meta_features(spark: SparkSession, source: str, out: str) -> None:
    """Rewrite an annotation file with completed transcript rows; of a repeated attribute the first value stays."""
    rows = completed_lines(gtf.read_gtf_lines(spark, source))

    def dot(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit("."))

    ordered = rows.orderBy("gene_ord", F.col("tx_ord").asc_nulls_first(), "level", "ord")
    ordered.select(F.concat_ws(
        "\t", "contig", "source", "type", dot("start"), dot("end"), dot("score"), "strand", dot("frame"), first_values(F.col("attribute_text"))
    ).alias("value")).write.mode("overwrite").text(out)


def extract_sequences(
    spark: SparkSession, source: str, fasta_path: str, out: str, fai: str | None = None, gene_id: str | None = None,
    feature_type: str | None = None,
) -> None:
    """One FASTA record per transcript: its span, or its regions of one type in file order."""
    annotation = gtf.read_annotation(spark, source)
    text = fasta.read_genome(spark, fasta_path, fai)
    transcripts = annotation.transcripts
    if gene_id:
        transcripts = transcripts.where(F.col("gene_id") == gene_id)
    if feature_type is None:
        spans = transcripts.select("contig", "transcript_id", "start", "end")
        found = G.fetch_spans(spans, text, ["transcript_id"]).select("transcript_id", "sequence")
    else:
        wanted = annotation.features.where(F.col("type") == C.canonical_type(feature_type)).join(
            transcripts.select("contig", "transcript_id"), ["contig", "transcript_id"], "left_semi")
        pieces = G.fetch_spans(wanted.select("contig", "transcript_id", "ord", "start", "end"), text, ["transcript_id", "ord"])
        found = pieces.groupBy("transcript_id").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "sequence"))), lambda x: x["sequence"]), "").alias("sequence"))
    writers.write_fasta(found.where("sequence is not null"), out)


def aggregate_profiles(spark: SparkSession, events: str, out: str, packages: list[str]) -> None:
    """Per-method totals of exported profiler recordings, with the top lists and a summary."""
    rows = tables.read_profile_events(spark, events).withColumn("method", profile.one_line(profile.method_of(F.col("frames"), packages)))
    totals = profile.method_totals(rows)
    writers.write_tsv(profile.recording_summary(rows), out + "/summary")
    writers.write_tsv(profile.top_methods(totals, "cpu_samples"), out + "/top_cpu")
    writers.write_tsv(profile.top_methods(totals, "allocated_bytes"), out + "/top_alloc")
    weight = F.col("cpu_samples") + F.col("allocated_bytes")
    writers.write_tsv(totals.orderBy(F.desc(weight), "recording", "method"), out + "/methods")


def id_based_differences(
    spark: SparkSession, target_gtf: str, query_gtf: str, out: str, target_fasta: str | None = None,
    query_fasta: str | None = None, target_fai: str | None = None, query_fai: str | None = None,
) -> None:
    """The id based comparison: three columns, gene by gene. With both genomes, texts of equal length are compared."""
    if (target_fasta is None) != (query_fasta is None):
        raise ValueError("texts are compared with both genomes or without any")
    target, query = gtf.read_annotation(spark, target_gtf), gtf.read_annotation(spark, query_gtf)
    columns = ["contig", "gene_id", "start", "end", "fwd"]
    genes = pairing.pair_by_id(target.genes.select(columns), query.genes.select(columns), ["contig", "gene_id"])
    own = ["contig", "gene_id", "transcript_id", "start", "end", "fwd"]
    transcripts = pairing.transcripts_of_gene_pairs(genes, target.transcripts.select(own), query.transcripts.select(own))
    regions = pairing.old_style_region_pairs(target.features, query.features, transcripts)
    genomes = () if target_fasta is None else (
        fasta.read_genome(spark, target_fasta, target_fai), fasta.read_genome(spark, query_fasta, query_fai))
    writers.write_tsv(
        pairing.old_style_differences(genes, transcripts, regions, *genomes).withColumnRenamed("gene_id", "geneId"), out
    )
