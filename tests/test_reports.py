"""Every report against the DuckDB result of its text on the same tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import compare

TEXTS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


def test_texts_belong_to_reports():
    assert set(TEXTS) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(TEXTS))
def test_report_equals_text(spark, sf_dir, con, key):
    assert compare.mismatch(QUERIES[key](spark, sf_dir), con, TEXTS[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(TEXTS)))
def test_report_has_rows(spark, sf_dir, key):
    assert QUERIES[key](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r.risk_decile for r in rows] == list(range(1, 11))
    assert sum(r.users for r in rows) == 150
