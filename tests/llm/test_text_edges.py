"""Every text query on empty tables and on odd rows."""

import os

import pytest
from edge_tables import write

from docketlake.llm import queries, tokens


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [write(spark, str(tmp_path_factory.mktemp(n)), odd) for n, odd in (("empty", False), ("odd", True))]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folders, name):
    if name in ("p8_ids", "p9_pack") and not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    empty, odd = (queries.QUERIES[name](spark, f) for f in folders)
    assert empty.columns == odd.columns and empty.count() == 0
    rows = [tuple(map(str, r)) for r in odd.collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
