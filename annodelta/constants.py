"""Names, thresholds and tables that results depend on."""

# --- Fixed values: canonical feature types, in report order --------------------
GENE = "gene"
TRANSCRIPT = "transcript"
EXON = "exon"
CDS = "CDS"
UTR5 = "five_prime_utr"
UTR3 = "three_prime_utr"
UTR = "utr"
INTRON = "intron"
START_CODON = "start_codon"
STOP_CODON = "stop_codon"
FEATURE_TYPES = [GENE, TRANSCRIPT, EXON, CDS, UTR5, UTR3, UTR, INTRON, START_CODON, STOP_CODON]

# --- Fixed values: other spellings of the feature types (lower case) -----------
TYPE_SYNONYMS = {
    "mrna": TRANSCRIPT,
    "cds": CDS,
    "5utr": UTR5,
    "five_prime_utr": UTR5,
    "3utr": UTR3,
    "three_prime_utr": UTR3,
    "utr": UTR,
    "gene": GENE,
    "transcript": TRANSCRIPT,
    "exon": EXON,
    "intron": INTRON,
    "start_codon": START_CODON,
    "stop_codon": STOP_CODON,
}

PROTEIN_CODING = "protein_coding"
LIFTED_BIOTYPE = "Liftoff"

# --- Fixed values: mapping files ------------------------------------------------
GENE_ID_MAPPING = "GENE_ID_MAPPING"
TRANSCRIPT_ID_MAPPING = "TRANSCRIPT_ID_MAPPING"
NAME_MAPPING = "NAME_MAPPING"
STRUCTURE_BASED_MAPPING = "STRUCTURE_BASED_MAPPING"
OVERLAPPING = "OVERLAPPING"
DISTANCE = "DISTANCE"
MAPPING_ORIGINS = [
    GENE_ID_MAPPING, TRANSCRIPT_ID_MAPPING, NAME_MAPPING, STRUCTURE_BASED_MAPPING, OVERLAPPING, DISTANCE,
]
MAPPING_COLUMNS = [
    "contig", "queryId", "targetId", "queryTranscriptId", "targetTranscriptId", "mapping_origins",
]
UNMAPPED_COLUMNS = ["contig", "geneId", "name", "origin"]

# --- Fixed values: the difference table -----------------------------------------
DIFFERENCE_COLUMNS = [
    "impact", "contig", "targetGeneId", "queryGeneId", "targetBioType", "queryBiotype", "featureType",
    "difference", "targetTranscriptId", "queryTranscriptId", "targetTranscriptBiotype",
    "queryTranscriptBiotype", "targetFeatureStart", "queryFeatureStart", "targetFeatureStop",
    "queryFeatureStop", "targetStrand", "queryStrand",
]
IMPACTS = ["NONE", "MODIFIER", "LOW", "MODERATE", "HIGH"]

# --- Fixed values: locus scoring and matching -----------------------------------
WEIGHT_MODEL = 0.2
WEIGHT_CHAIN = 0.2
WEIGHT_ENDS = 0.55
WEIGHT_DISTANCE = 0.5
MIN_MATCH_SCORE = 0.1
MODEL_SHARE = 0.5
MIDPOINT_DECAY_BP = 10_000.0
START_DECAY_BP = 150.0
STOP_DECAY_BP = 250.0
START_SHARE = 0.4
STOP_SHARE = 0.6
CHAIN_GAP_COST = 2
CHAIN_SUBSTITUTION_COST = 1

# --- Fixed values: exon pairing --------------------------------------------------
GAP_PENALTY = 2
GAP_DELTA_CAP = 200
LENGTH_CAP_BP = 200
LENGTH_CAP_SHARE = 0.2
CONTAINMENT_PAD_BP = 10

# --- Fixed values: sequence alignment acceptance ---------------------------------
MIN_ALIGNMENT_IDENTITY = 95.0
MIN_ALIGNMENT_COVERAGE = 80.0
SAM_NOT_PRIMARY = 0x900
PROFILE_TOP_N = 100


def _standard_genetic_code() -> dict[str, str]:
    # Fixed value: standard genetic code, codons in TCAG order.
    acids = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    codons = (a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG")
    return dict(zip(codons, acids))


CODON_TABLE = _standard_genetic_code()


def canonical_type(name: str) -> str | None:
    """Canonical feature type for any accepted spelling, or None."""
    return TYPE_SYNONYMS.get(name.strip().lower())
