"""Every registered query against its SQL, at the smallest scale."""

import check_oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    state, detail = check_oracle.compare(spark, duck, SF, name)
    assert state == "ok", detail


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r["ndcg_cut_10"] <= 1 for r in rows)
