"""Command line: python -m annodelta MODE --option value …"""

from __future__ import annotations

import argparse
import time

from annodelta import constants as C
from annodelta.compat import Compat
from annodelta.session import build_session
from annodelta.sinks.writers import write_overall_time, write_stage_times


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="annodelta", description="Compare two releases of a genome annotation.")
    parser.add_argument("--master", help="Spark master; taken from the environment when absent")
    modes = parser.add_subparsers(dest="mode", required=True)

    def mode(name: str, *options: str, **extra: dict) -> argparse.ArgumentParser:
        sub = modes.add_parser(name)
        for option in options:
            required = option.endswith("!")
            sub.add_argument("--" + option.rstrip("!"), required=required)
        for option, settings in extra.items():
            sub.add_argument("--" + option.replace("_", "-"), **settings)
        return sub

    flag = {"action": "store_true"}
    sides = ("target-gtf!", "query-gtf!")
    texts = ("target-fasta", "query-fasta", "target-fidx", "query-fidx")
    cutoff = {"type": float, "default": 1.0}
    mode("newMapping", *sides, *texts, "o!", allowed_types={"nargs": "*"}, useHomology=flag, similarity=cutoff)
    mode("newTranscriptMapping", *sides, *texts, "mapping!", "o!", allowed_types={"nargs": "*"}, useHomology=flag, similarity=cutoff)
    mode("newMappingVal", *sides, "target-fasta!", "query-fasta!", "target-fidx", "query-fidx", "mapping!", "o!")
    mode("filterGeneMappings", "mapping!", "o!", origins={"nargs": "+", "required": True, "choices": C.MAPPING_ORIGINS}, require_all=flag)
    mode("analysis", *sides, "config!", "fasta", "fidx", "o!", mapping_only_cds=flag, ignore_strand=flag, compat=flag)
    mode("cliqueAnalysis", *sides, "o!", ignore_strand=flag)
    mode("liftedDifferences", *sides, "lifted-query-gtf!", "query-fasta!", "target-fasta!", "query-fidx", "target-fidx", "o!")
    mode("gtfStats", "inDir!", "outDir!", recursive=flag)
    mode("addMetaFeatures", "gtf!", "o!")
    mode("benchmark", "events!", "o!", packages={"nargs": "*"})
    mode("firstAnalysis", *sides, *texts, "o!")
    mode("seqExtractor", "gtf!", "fasta!", "fidx", "o!", "gene-id", "feature-type")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(f"annodelta-{args.mode}", args.master)
    began = time.perf_counter()
    _run(spark, args)
    spent = round((time.perf_counter() - began) * 1000)
    if args.mode in ("newMapping", "newTranscriptMapping"):
        write_overall_time(spark, spent, args.o)
    elif args.mode == "firstAnalysis":
        write_stage_times(spark, [(args.mode, spent)], args.o)
    print(f"{args.mode}: {spent} ms")


def _run(spark, a: argparse.Namespace) -> None:
    from annodelta.plans import analysis, mapping, reports

    if a.mode == "newMapping":
        mapping.map_genes(spark, a.target_gtf, a.query_gtf, a.o, a.allowed_types, a.target_fasta, a.query_fasta,
                          a.target_fidx, a.query_fidx, a.useHomology, a.similarity)
    elif a.mode == "newTranscriptMapping":
        mapping.map_transcripts(spark, a.target_gtf, a.query_gtf, a.mapping, a.o, a.allowed_types, a.target_fasta,
                                a.query_fasta, a.target_fidx, a.query_fidx, a.useHomology, a.similarity)
    elif a.mode == "newMappingVal":
        mapping.validate_mapping(spark, a.target_gtf, a.query_gtf, a.mapping, a.target_fasta, a.query_fasta, a.o,
                                 a.target_fidx, a.query_fidx)
    elif a.mode == "filterGeneMappings":
        mapping.filter_mapping(spark, a.mapping, a.o, a.origins, a.require_all)
    elif a.mode == "analysis":
        compat = Compat(reverse_introns_unpaired=True, none_row_short=True) if a.compat else Compat()
        analysis.analyse(spark, a.target_gtf, a.query_gtf, a.config, a.o, a.fasta, a.fidx, not a.ignore_strand,
                         a.mapping_only_cds, compat)
    elif a.mode == "cliqueAnalysis":
        table = reports.clique_analysis(spark, a.target_gtf, a.query_gtf, a.o, not a.ignore_strand)
        table.show(max(1, table.count()), truncate=False)  # a row per contig and the total
    elif a.mode == "liftedDifferences":
        reports.lifted_differences(spark, a.query_gtf, a.target_gtf, a.lifted_query_gtf, a.query_fasta, a.target_fasta,
                                   a.o, a.query_fidx, a.target_fidx)
    elif a.mode == "gtfStats":
        reports.gtf_statistics(spark, a.inDir, a.outDir, a.recursive)
    elif a.mode == "addMetaFeatures":
        reports.add_meta_features(spark, a.gtf, a.o)
    elif a.mode == "benchmark":
        reports.aggregate_profiles(spark, a.events, a.o, a.packages or [])
    elif a.mode == "firstAnalysis":
        reports.id_based_differences(spark, a.target_gtf, a.query_gtf, a.o, a.target_fasta, a.query_fasta,
                                     a.target_fidx, a.query_fidx)
    elif a.mode == "seqExtractor":
        reports.extract_sequences(spark, a.gtf, a.fasta, a.o, a.fidx, a.gene_id, a.feature_type)
