"""Every query with a SQL counterpart gives DuckDB's rows."""

import pytest

from pulseforge.plans import catalog
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
PLANS = catalog.plans()


@pytest.mark.parametrize("name", list(PLANS))
def test_same_rows(spark, name):
    assert spark_rows(PLANS[name].frame(spark, SF)) == duck_rows(PLANS[name].sql(), SF)


@pytest.mark.parametrize("name", ["beat_families", "qt_hours", "raw_window", "sections", "summary_rows", "export_json"])
def test_kernels_give_rows(spark, name):
    assert catalog.KERNELS[name](spark, SF).columns


def test_entry_has_every_query_and_no_stray_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(PLANS) <= set(entry.oracle_sql())
