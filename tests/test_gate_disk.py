"""What the gate's queries leave on disk follows nodes, queries and their candidates, not the words of nodes or pairs that meet in a word."""

import pytest

from loam import session
from loam.plans import search
from loam.plans.common import node_queries, nodes

from tests.test_travel import all_sent

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query", ["gate_fit", "param_sweep", "candidate_pool", "gate_threshold"])
def test_neither_words_nor_pairs_reach_the_disk(spark, query):
    """60 nodes by words and 10 by vector are a query's candidates; a node has some 40 different words."""
    most = nodes(spark, SF).count() + 70 * node_queries(spark, SF).count()
    at = len(session._WRITTEN)
    got, sent = all_sent(search.QUERIES[query](spark, SF))
    written = [spark.read.parquet(f).count() for f in session._WRITTEN[at:]]
    assert got and written and max(written) <= most
    assert sent <= most
