"""Every llm query runs over its whole table; those with SQL agree with it."""

import pytest
from sheaf.llm.registry import ORACLES, QUERIES

from tests.conftest import SF
from tests.oracle import check, database

ROWS = {"op1_html_wrapper": "pages", "op9_nearest_neighbours": None, "op13_conversation_repair": "(select distinct conv_id from conversations)"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    if name in ORACLES:
        check(QUERIES[name], ORACLES[name], spark, SF)
        return
    n = QUERIES[name](spark, SF).count()
    table = ROWS.get(name, "documents")
    expected = f"select count(*) from {table}" if table else "select 20 * count(*) from embeddings where vec_id % 20 = 0"
    assert n == database(SF).execute(expected).fetchone()[0]
