import pytest

import __spark_entry__ as contract
from workload.check import compare

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "signature_gene_mapping", "transcript_mapping", "mapping_filter_any", "id_join_diff", "overlap_join", "overlap_components",
    "clique_stats", "stats_counts", "intron_synthesis", "lifted_stats", "same_protein", "model_jaccard", "chain_similarity",
    "comparator_diff_long", "sam_cigar_filter", "id_history_closure",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    good, text = compare(spark, FOLDER, name)
    assert good, text


def test_contract_is_consistent(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[0] == "contig"
