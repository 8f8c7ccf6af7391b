"""Every named query equals its SQL twin row for row; those without one run and have rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    from compare_oracle import connect

    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    from compare_oracle import differences

    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.sql(entry.oracle_sql()[name]).df()) == ""


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(df.columns) > 1 and not df.isEmpty()


def test_catalogue():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "metric", "n", "mean", "sd", "ci95_low", "ci95_high"]
    assert df.count() == 35
