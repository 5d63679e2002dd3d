"""Every registered query against its SQL on the driver's tables."""

from __future__ import annotations

import pytest

from pulseframe import queries as Q
from pulseframe.source_queries import WITHOUT_SQL
from tests.conftest import DATA, duck, rows_of

FOLDER = str(DATA / "sf0.01")
SQL = Q.oracle_sql()


def test_every_query_has_sql():
    assert set(Q.queries()) - set(SQL) == set(WITHOUT_SQL)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_whole_plan_runs(spark, name):
    assert Q.queries()[name](spark, FOLDER).count() > 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert rows_of(Q.queries()[name](spark, FOLDER).toArrow()) == rows_of(duck(SQL[name], FOLDER, arrow=True))


def test_the_comparison_tells_nan_from_null():
    import pyarrow as pa

    assert rows_of(pa.table({"x": [float("nan")]})) != rows_of(pa.table({"x": pa.array([None], pa.float64())}))


def test_entry(spark):
    assert Q.entry(spark).count() > 0
