"""Every registered query against its SQL twin."""

import pytest
from compare import compare

from trialspark.catalog import load_all

QUERIES = load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], sf) == ""


def test_every_inventory_item_has_a_query():
    groups = {"S": 8, "P": 17, "F": 5, "J": 6, "T": 11, "D": 16, "E": 8, "W": 4, "L": 4, "U": 4, "A": 23, "X": 5, "K": 5, "V": 9, "B": 2, "R": 1}
    wanted = {f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1)} | {f"M{i}" for i in range(26)}
    assert wanted - {q.survey for q in QUERIES.values()} == set()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["env", "n", "pcc"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
