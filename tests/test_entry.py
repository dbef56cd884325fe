import check
import pytest

import __spark_entry__ as entry
from clickatlas import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "url_normalize", "label_classes", "page_links", "build_link_graph_nodes", "link_degrees", "page_forms", "shop_collections", "crawl_triggers", "graph_summary",
    "bfs_paths", "simple_paths", "matched_triggers", "list_forms", "accepted_artifacts", "folded_transcripts", "run_summaries", "frame_stream", "suggested_labels",
]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    ok, note = check.compare(entry.queries()[name](spark, SF), check.connect(SF), entry.oracle_sql()[name])
    assert ok, note
