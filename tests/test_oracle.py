"""Named queries against DuckDB on the smallest tables.

Runs the quick ones; ``python tests/oracle.py`` runs all of them at sf0.01.
"""

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUICK = ["pseudobulk_de", "pathways_to_structures", "cell_mapping_to_clusters", "clusters_to_structures", "he_morphology", "contours_to_structure", "niche_fusion",
         "consensus_annotation", "visual_override", "critic_report", "build_claims", "pending_work", "input_hash", "text_list", "gaussian_smooth", "point_in_polygon",
         "chunk_text", "vector_top_k", "read_geojson_features", "stream_qc_windows"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


@pytest.mark.parametrize("name", QUICK)
def test_against_duckdb(spark, con, name):
    assert oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
