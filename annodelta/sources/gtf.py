"""Reading GTF files into the annotation model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annodelta import constants as C
from annodelta.annotation import Annotation, synthesize_genes, with_introns
from annodelta.functions.text import attribute_value, parse_attributes

COLUMNS = ["contig", "source", "type", "start", "end", "score", "strand", "frame"]


def canonical(type_column: Column) -> Column:
    """Canonical feature type of any known spelling, null for others."""
    table = F.create_map(*[F.lit(x) for pair in C.TYPE_SYNONYMS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(type_column)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """GTF columns from a ``value`` column of lines; comments and short lines are dropped.

    Works on batch and streaming input alike. Coordinates of -1 or '.' become null, and the
    attribute text is kept as it is: single attributes are cut out of it where needed.
    """
    field = F.split("value", "\t")

    def place(i: int) -> Column:
        number = field[i].try_cast("long")
        return F.when(number >= 0, number)

    def optional(i: int) -> Column:
        return F.when(field[i] != ".", field[i])

    keep = [c for c in lines.columns if c != "value"]
    return lines.where(~F.col("value").startswith("#") & (F.size(field) >= 9)).select(
        *keep,
        field[0].alias("contig"), field[1].alias("source"), field[2].alias("type"),
        place(3).alias("start"), place(4).alias("end"), optional(5).alias("score"),
        field[6].alias("strand"), optional(7).alias("frame"), field[8].alias("attribute_text"),
    )


def read_gtf_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Lines of one file or a folder of .gtf files (any letter case), with ``file`` and ``ord``.

    ``ord`` = (byte offset of the split, line number in the read), which follows the file order
    within one file however its splits were packed into tasks.
    """
    reader = spark.read
    if not path.lower().endswith((".gtf", ".gtf.gz")):
        reader = reader.option("pathGlobFilter", "*.[gG][tT][fF]").option("recursiveFileLookup", str(recursive).lower())
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("ord"),
    )
    return parse_lines(lines)


def to_annotation(lines: DataFrame, introns: bool = True) -> Annotation:
    """Normalise GTF lines to gene, transcript and feature tables.

    Genes without a row of their own are derived from their transcripts, transcripts without one
    from their regions. Unknown feature types are ignored.
    """
    rows = lines.withColumns({
        "kind": canonical(F.col("type")),
        "fwd": F.col("strand") != "-",
        **{k: attribute_value(F.col("attribute_text"), k) for k in (
            "gene_id", "transcript_id", "gene_name", "gene_biotype", "transcript_name", "transcript_biotype")},
    }).where(F.col("kind").isNotNull() & F.col("gene_id").isNotNull())

    features = rows.where(~F.col("kind").isin(C.GENE, C.TRANSCRIPT) & F.col("transcript_id").isNotNull()).select(
        "contig", "gene_id", "transcript_id", F.col("kind").alias("type"), "start", "end", "fwd", "ord"
    )
    of_transcripts = rows.where((F.col("kind") != C.GENE) & F.col("transcript_id").isNotNull())
    listed = F.col("kind") == C.TRANSCRIPT

    def own_or_any(c: str) -> Column:
        return F.coalesce(F.min(F.when(listed, F.col(c))), F.min(c)).alias(c)

    gathered = of_transcripts.groupBy("contig", "gene_id", "transcript_id").agg(
        *[own_or_any(c) for c in ("transcript_name", "transcript_biotype", "source", "gene_name", "gene_biotype", "fwd")],
        F.coalesce(F.min(F.when(listed, F.col("start"))), F.min(F.when(~listed, F.col("start")))).alias("start"),
        F.coalesce(F.max(F.when(listed, F.col("end"))), F.max(F.when(~listed, F.col("end")))).alias("end"),
    )
    transcripts = gathered.select(
        "contig", "gene_id", "transcript_id", "transcript_name", "transcript_biotype", "source", "start", "end", "fwd"
    )
    columns = ["contig", "gene_id", "gene_name", "gene_biotype", "source", "start", "end", "fwd"]
    gene_rows = rows.where(F.col("kind") == C.GENE).select(*columns)
    derived = synthesize_genes(gathered).join(gene_rows.select("contig", "gene_id").distinct(), ["contig", "gene_id"], "left_anti")
    annotation = Annotation(gene_rows.unionByName(derived.select(*columns)), transcripts, features)
    return with_introns(annotation) if introns else annotation


def read_annotation(spark: SparkSession, path: str, introns: bool = True) -> Annotation:
    return to_annotation(read_gtf_lines(spark, path), introns)


def with_attributes(lines: DataFrame) -> DataFrame:
    """Lines with the full attribute map, for callers that need arbitrary keys."""
    return lines.withColumn("attributes", parse_attributes(F.col("attribute_text")))


def contig_order(spark: SparkSession, path: str) -> DataFrame:
    """(contig, first): where in a file each contig first appears."""
    return read_gtf_lines(spark, path).groupBy("contig").agg(F.min("ord").alias("first"))


def contig_differences(target: DataFrame, query: DataFrame) -> DataFrame:
    """Contigs known to one release only (contig, origin)."""
    t, q = target.select("contig").distinct(), query.select("contig").distinct()
    return t.join(q, "contig", "left_anti").withColumn("origin", F.lit("TARGET")).unionByName(
        q.join(t, "contig", "left_anti").withColumn("origin", F.lit("QUERY"))
    )
