import json
import os
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from annodelta import constants as C
from annodelta.cli import main
from annodelta.functions.text import first_values
from annodelta.operators.genome import fetch_spans
from annodelta.sinks.writers import write_fasta
from annodelta.sources import fasta, fasta_source, gtf
from annodelta.streaming.gtf_stream import stream_gtf_lines


def line(contig, kind, start, end, strand, gene, tx=None, **more):
    attributes = [("gene_id", gene)] + ([("transcript_id", tx)] if tx else []) + list(more.items())
    text = " ".join(f'{k} "{v}";' for k, v in attributes)
    return "\t".join([contig, "havana", kind, str(start), str(end), ".", strand, ".", text])


CODING = {"gene_biotype": "protein_coding", "transcript_biotype": "protein_coding", "gene_name": "N1"}


def target_lines():
    return [
        "#comment",
        line("1", "transcript", 101, 400, "+", "G1", "T1", **CODING),
        line("1", "exon", 101, 160, "+", "G1", "T1", **CODING),
        line("1", "CDS", 111, 160, "+", "G1", "T1", **CODING),
        line("1", "exon", 301, 400, "+", "G1", "T1", **CODING),
        line("1", "cds", 301, 330, "+", "G1", "T1", **CODING),
        line("2", "transcript", 500, 900, "-", "G2", "T2", **CODING),
        line("2", "exon", 800, 900, "-", "G2", "T2", **CODING),
        line("2", "exon", 650, 700, "-", "G2", "T2", **CODING),
        line("2", "exon", 500, 550, "-", "G2", "T2", **CODING),
        line("2", "transcript", -1, -1, "+", "G3", "T3", **{**CODING, "transcript_biotype": "lncRNA"}),
        line("2", "exon", 2001, 2300, "+", "G3", "T3", **{**CODING, "transcript_biotype": "lncRNA"}),
    ]


def query_lines():
    lines = target_lines()
    lines[4] = line("1", "exon", 301, 420, "+", "G1", "T1", **CODING)  # longer last exon
    lines[1] = line("1", "transcript", 101, 420, "+", "G1", "T1", **CODING)
    del lines[8]  # an exon of T2 is gone
    return lines[:-2] + [  # T3 moved far away under a new name
        line("2", "transcript", 6001, 6300, "+", "G4", "T4", **CODING),
        line("2", "exon", 6001, 6300, "+", "G4", "T4", **CODING),
    ]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "target.gtf").write_text("\n".join(target_lines()) + "\n")
    (root / "query.gtf").write_text("\n".join(query_lines()) + "\n")
    rng = random.Random(1)
    contigs = {"1": "".join(rng.choice("ACGT") for _ in range(1000)), "2": "".join(rng.choice("ACGT") for _ in range(9001))}
    contigs["2"] = contigs["2"][:6000] + contigs["2"][2000:2300] + contigs["2"][6300:]  # T3's text again at T4
    text, index, at = "", [], 0
    for name, bases in contigs.items():
        text += f">{name} made up\n"
        index.append((name, len(bases), len(text), 60, 61))
        text += "\n".join(bases[i:i + 60] for i in range(0, len(bases), 60)) + "\n"
    (root / "genome.fa").write_text(text)
    fai = "".join("\t".join(map(str, row)) + "\n" for row in index)
    (root / "genome.fa.fai").write_text(fai)
    blocks = []
    for piece in [text[i:i + 700] for i in range(0, len(text), 700)] + [""]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(piece.encode()) + packer.flush()
        blocks.append(b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
                      + body + struct.pack("<II", zlib.crc32(piece.encode()), len(piece)))
    (root / "packed.fa.gz").write_bytes(b"".join(blocks))
    (root / "packed.fa.gz.fai").write_text(fai)
    (root / "config.json").write_text(json.dumps({
        "features": {n: {"enabled": True} for n in (
            "transcript_start", "transcript_stop", "transcript_length", "transcript_biotype", "start", "stop", "length",
            "sequence", "same_protein")},
        "transcript_features": {"exon": {"enabled": True, "impact": "HIGH"}, "cds": {"enabled": True}, "intron": {"enabled": True}},
        "gene_biotypes": {"allowed": ["protein_coding"]},
    }))
    return root, contigs


def read_text(path):
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return [row for p in parts for row in open(os.path.join(path, p)).read().splitlines()]


@pytest.mark.parametrize("name", ["genome.fa", "packed.fa.gz"])
@pytest.mark.parametrize("chunk", [64, 1000])
@pytest.mark.parametrize("split", [300, 2500, 1 << 20])
def test_genome_chunks_hold_the_whole_text(spark, folder, name, chunk, split):
    root, contigs = folder
    rows = fasta.read_genome(spark, str(root / name), chunk=chunk, split_bytes=split).collect()
    for contig, bases in contigs.items():
        parts = sorted((r.chunk_id, r.chunk_start, r.seq) for r in rows if r.contig == contig)
        assert "".join(p[2] for p in parts) == bases
        assert all(start == i * chunk + 1 and (len(seq) == chunk or i == parts[-1][0]) for i, start, seq in parts)


def test_spans_across_chunks(spark, folder):
    root, contigs = folder
    genome = fasta.read_genome(spark, str(root / "genome.fa"), chunk=64)
    spans = spark.createDataFrame([("1", 1, 60, 200), ("1", 2, 990, 1001), ("2", 3, 1, 9001), ("9", 4, 1, 2)], "contig string, id int, start long, end long")
    found = {r.id: r.sequence for r in fetch_spans(spans, genome, ["id"], 64).collect()}
    assert found == {1: contigs["1"][59:200], 2: None, 3: contigs["2"], 4: None}


def test_ranges_of_a_file(folder):
    root, contigs = folder
    options = {"path": str(root / "genome.fa"), "chunk": "64", "splitBytes": "2500"}
    reader = fasta_source.FilteringFastaReader(options)
    parts = reader.partitions()
    assert sorted((p.first, p.count) for p in parts) == [(0, -1), (0, 39), (39, 39), (78, 39), (117, 39)]
    assert list(reader.pushFilters([EqualTo(("contig",), "1"), EqualTo(("seq",), "A")])) == [EqualTo(("seq",), "A")]
    assert [(p.first, p.count) for p in reader.partitions()] == [(0, -1)]
    read = [row for p in reader.partitions() for batch in reader.read(p) for row in batch.to_pylist()]
    assert "".join(r["seq"] for r in read) == contigs["1"] and {r["contig"] for r in read} == {"1"}
    assert list(reader.pushFilters([In(("contig",), ("2",))])) == [] and [p.fasta for p in reader.partitions()] == [""]


def test_contig_filter_reaches_the_source(spark, folder):
    root, contigs = folder
    before = spark.conf.get(fasta_source.PUSHDOWN)
    spark.conf.set(fasta_source.PUSHDOWN, "true")
    try:
        rows = fasta.read_genome(spark, str(root / "genome.fa"), chunk=64).where("contig = '1' and chunk_id > 2")
        assert "".join(r.seq for r in rows.orderBy("chunk_id").collect()) == contigs["1"][192:]
    finally:
        spark.conf.set(fasta_source.PUSHDOWN, before)


def test_blocks_are_found_from_any_byte(folder):
    data = (folder[0] / "packed.fa.gz").read_bytes()
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += fasta_source.block_length(data, at)
    for k in range(0, starts[-1], 7):
        assert fasta_source.first_block(data[k:], True) + k == min(s for s in starts if s >= k)
    # A mark inside compressed text is no block: its length leads nowhere.
    fake = bytearray(b"x" * 40 + data)
    fake[5:21] = data[:16]
    assert fasta_source.first_block(bytes(fake), True) == 40


def test_written_records_are_read_back(spark, tmp_path):
    texts = {f"T{k:03d}": "ACGT" * k + "A" for k in range(200)}
    df = spark.createDataFrame(list(texts.items()), "transcript_id string, sequence string")
    out = str(tmp_path / "records")
    for _ in range(2):  # the second writing takes the place of the first
        write_fasta(df, out)
    names = os.listdir(out)
    assert "_SUCCESS" in names and 2 <= len(names) < 50
    assert len([n for n in names if n.endswith(".fa")]) == len([n for n in names if n.endswith(".fai")])
    genome = fasta.read_genome(spark, out, chunk=64, split_bytes=500)
    got = {}
    for r in genome.orderBy("contig", "chunk_id").collect():
        got[r.contig] = got.get(r.contig, "") + r.seq
    assert got == texts
    write_fasta(df.where("false"), out)
    assert fasta.read_genome(spark, out).count() == 0


def test_annotation_of_a_file(spark, folder):
    annotation = gtf.read_annotation(spark, str(folder[0] / "target.gtf"))
    genes = {r.gene_id: (r.contig, r.start, r.end, r.gene_name) for r in annotation.genes.collect()}
    assert genes == {"G1": ("1", 101, 400, "N1"), "G2": ("2", 500, 900, "N1"), "G3": ("2", 2001, 2300, "N1")}
    introns = sorted((r.start, r.end) for r in annotation.features.where("type = 'intron'").collect())
    assert introns == [(161, 300), (551, 649), (701, 799)]
    assert annotation.features.where("type = 'CDS'").count() == 2


def test_streaming_reader_parses_like_the_batch_reader(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.gtf").write_text("\n".join(target_lines()))
    query = stream_gtf_lines(spark, str(source)).writeStream.format("memory").queryName("gtf_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("gtf_rows").count() == len(target_lines()) - 1


def test_analysis_reports_the_made_changes(spark, folder, tmp_path):
    root, _ = folder
    out = str(tmp_path / "diff.tsv")
    main(["analysis", "--target-gtf", str(root / "target.gtf"), "--query-gtf", str(root / "query.gtf"), "--config",
          str(root / "config.json"), "--fasta", str(root / "genome.fa"), "--o", out])
    rows = [r.split("\t") for r in read_text(out)]
    assert rows[0][0] == "impact" and len(rows[0]) == 18
    found = {(r[8], r[6], r[7], r[0], r[12], r[13], r[14], r[15]) for r in rows[1:]}
    assert found == {
        ("T1", "transcript", "stop", "MODERATE", "101", "101", "400", "420"),
        ("T1", "transcript", "length", "MODERATE", "101", "101", "400", "420"),
        ("T1", "transcript", "seq", "MODERATE", "101", "101", "400", "420"),
        ("T1", "exon", "length", "HIGH", "301", "301", "400", "420"),
        ("T1", "exon", "stop", "HIGH", "301", "301", "400", "420"),
        ("T1", "exon", "seq", "HIGH", "301", "301", "400", "420"),
        ("T2", "exon", "missingFeatureEntryFileInQuery", "HIGH", "650", "-1", "700", "-1"),
        ("T2", "intron", "missingFeatureEntryFileInQuery", "MODERATE", "551", "-1", "649", "-1"),
        ("T2", "intron", "missingFeatureEntryFileInQuery", "MODERATE", "701", "-1", "799", "-1"),
        ("T2", "intron", "missingFeatureEntryFileInTarget", "MODERATE", "-1", "551", "-1", "799"),
    }
    keys = [(r[1]) for r in rows[1:]]
    assert keys == sorted(keys)
    beside = [r.split("\t") for r in read_text(out + ".minimap2")][1:]
    assert {(r[8], r[9]) for r in beside} == {("T3", "T4")}
    assert read_text(out + ".unmapped_queries") == read_text(out + ".unmapped_targets") == []


def test_report_has_contigs_in_file_order(spark, folder, tmp_path):
    def lines(stop):
        return [line(c, kind, 101, stop, "+", "G" + c, "T" + c, **CODING) for c in ("11", "7", "1") for kind in ("transcript", "exon")]

    for side, stop in (("target", 400), ("query", 420)):
        (tmp_path / f"{side}.gtf").write_text("\n".join(lines(stop)) + "\n")
    out = str(tmp_path / "diff.tsv")
    main(["analysis", "--target-gtf", str(tmp_path / "target.gtf"), "--query-gtf", str(tmp_path / "query.gtf"), "--config",
          str(folder[0] / "config.json"), "--o", out])
    rows = [r.split("\t") for r in read_text(out)]
    assert rows[0] == list(C.DIFFERENCE_COLUMNS)
    assert list(dict.fromkeys(r[8] for r in rows[1:])) == ["T11", "T7", "T1"]
    by_contig = [[r for r in rows[1:] if r[8] == t] for t in ("T11", "T7", "T1")]
    assert all(len(part) > 2 for part in by_contig)


def test_first_attribute_values_stay(spark):
    text = 'gene_id "G1"; tag "basic"; tag "CCDS"; level 2; note "a; b";'
    row = spark.createDataFrame([(text,)], "t string").select(first_values(F.col("t"))).first()
    assert row[0] == 'gene_id "G1";tag "basic";level "2";note "a; b"'


def test_jobs_start_in_any_folder(folder, tmp_path):
    """Workers find the package though neither the folder nor the environment names it."""
    repo = Path(__file__).parents[1]
    code = (f"import sys; sys.path.insert(0, {str(repo)!r})\n"
            "from annodelta.session import build_session\nfrom annodelta.sources.fasta import read_genome\n"
            "spark = build_session(master='local[1]')\n"
            f"print('chunks', read_genome(spark, {str(folder[0] / 'packed.fa.gz')!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "chunks 3" in done.stdout, done.stderr[-2000:]


def test_mapping_modes_chain(spark, folder, tmp_path):
    root, _ = folder
    sides = ["--target-gtf", str(root / "target.gtf"), "--query-gtf", str(root / "query.gtf")]
    genome = str(root / "genome.fa")
    out = str(tmp_path / "map.tsv")
    main(["newMapping", *sides, "--o", out])
    assert sorted(read_text(out)) == sorted([
        "contig\tqueryId\ttargetId\tqueryTranscriptId\ttargetTranscriptId\tmapping_origins",
        "2\tG4\tG3\tT4\tT3\tNAME_MAPPING,STRUCTURE_BASED_MAPPING,DISTANCE:3701",
    ])
    assert len(read_text(out + ".overall_time")) == 1 and int(read_text(out + ".overall_time")[0]) > 0
    main(["newMapping", *sides, "--o", out + ".s", "--similarity", "0.7"])
    assert set(read_text(out)) <= set(read_text(out + ".s"))
    assert sorted(r.split("\t")[1] for r in read_text(out + ".unmapped") if not r.startswith("contig")) == ["G1", "G1", "G2", "G2"]
    main(["newMapping", *sides, "--o", out + ".h", "--useHomology", "--target-fasta", genome, "--query-fasta", genome])
    assert len(read_text(out + ".h")) == 2
    main(["newTranscriptMapping", *sides, "--mapping", out, "--o", out + ".t", "--allowed-types", "exon", "odd"])
    assert len([r for r in read_text(out + ".t") if r.startswith("2\t")]) == 1
    main(["newMappingVal", *sides, "--mapping", out, "--target-fasta", genome, "--query-fasta", genome, "--o", out + ".v"])
    assert read_text(out + ".v") == ["G3\tG4\tT3\tT4\ttrue"]
    main(["filterGeneMappings", "--mapping", out, "--o", out + ".f", "--origins", "OVERLAPPING", "NAME_MAPPING", "--require-all"])
    assert len([r for r in read_text(out + ".f") if r.startswith("2\t")]) == 0


def test_report_modes(spark, folder, tmp_path):
    root, contigs = folder
    sides = ["--target-gtf", str(root / "target.gtf"), "--query-gtf", str(root / "query.gtf")]
    genome = str(root / "genome.fa")
    main(["cliqueAnalysis", *sides, "--o", str(tmp_path / "clique")])
    assert sorted(read_text(str(tmp_path / "clique"))) == ["2\tQUERY\tNO_CLUSTER\tG4", "2\tTARGET\tNO_CLUSTER\tG3"]
    main(["liftedDifferences", *sides, "--lifted-query-gtf", str(root / "query.gtf"), "--query-fasta", genome, "--target-fasta",
          genome, "--o", str(tmp_path / "lifted")])
    total = [r for r in read_text(str(tmp_path / "lifted")) if r.startswith("TOTAL")]
    assert total == ["TOTAL\t3\t3\t3\t2\t2\t1\t0"]
    main(["gtfStats", "--inDir", str(root), "--outDir", str(tmp_path / "stats")])
    stats = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "stats" / "global"))
    assert {r["name"]: r["count"] for r in stats.where("prefix = 'target'").collect()} == {
        "gene": "3", "transcript": "3", "exon": "6", "CDS": "2", "intron": "3",
        C.UTR5: "0", C.UTR3: "0", C.START_CODON: "0", C.STOP_CODON: "0"}
    main(["addMetaFeatures", "--gtf", str(root / "target.gtf"), "--o", str(tmp_path / "meta")])
    rewritten = read_text(str(tmp_path / "meta"))
    assert len(rewritten) == len(target_lines()) - 1
    assert [r.split("\t")[3:5] for r in rewritten if '"T3"' in r] == [["2001", "2300"], ["2001", "2300"]]
    main(["seqExtractor", "--gtf", str(root / "target.gtf"), "--fasta", genome, "--o", str(tmp_path / "seq"), "--gene-id", "G1"])
    record = [row for path in (tmp_path / "seq").glob("*.fa") for row in path.read_text().splitlines()]
    assert record == [">T1", contigs["1"][100:400]]
    main(["firstAnalysis", *sides, "--o", str(tmp_path / "first")])
    found = read_text(str(tmp_path / "first"))
    assert "G3\tgene\tmissingInFile2" in found and "G1\tgene\tlength" in found
    assert read_text(str(tmp_path / "first.time_eval"))[1].startswith("firstAnalysis\t")
    events = tmp_path / "events.json"
    events.write_text("\n".join(json.dumps(e) for e in [
        {"kind": "cpu", "ts": "2024-01-01T00:00:00Z", "frames": ["java.A", "my.B"], "bytes": 0, "recording": "r"},
        {"kind": "alloc", "ts": "2024-01-01T00:00:01Z", "frames": ["java.A"], "bytes": 7, "recording": "r"}]))
    main(["benchmark", "--events", str(events), "--o", str(tmp_path / "prof"), "--packages", "my."])
    assert "r\tmy.B\t1\t0\t0" in read_text(str(tmp_path / "prof" / "methods"))
    assert "r\t1\t7\t1000000" in read_text(str(tmp_path / "prof" / "summary"))


def test_a_mapping_has_one_header_line(spark, tmp_path):
    from annodelta.sinks.writers import write_mapping

    pairs = spark.createDataFrame([(c, "q", "t", "Q", "T", ["NAME_MAPPING"], 5) for c in "123"], (
        "contig string, query_gene_id string, target_gene_id string, query_transcript_id string, target_transcript_id string, "
        "origins array<string>, distance long")).repartition(3, "contig")
    write_mapping(pairs, str(tmp_path / "map.tsv"))
    lines = read_text(str(tmp_path / "map.tsv"))
    assert len(lines) == 4 and sum(line.startswith("contig\t") for line in lines) == 1
