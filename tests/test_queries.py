"""Every query of the engine against its DuckDB equivalent, on the smallest tables."""

import pytest
from oracle import answers, same

from dredge.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected(tmp_path_factory):
    return answers(DIR, SQL, tmp_path_factory.mktemp("oracle"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, expected, name):
    assert same(QUERIES[name](spark, DIR), expected[name])


#: Queries of which the smallest tables have no rows.
BARE = {"grep_fixed_meta", "max_columns_window", "stream_set"}


def test_no_empty_answers(expected):
    assert {name for name, (_, rows) in expected.items() if not rows} <= BARE


def test_events_end_with_done(spark):
    rows = [r["value"] for r in QUERIES["json_sink"](spark, DIR).collect()]
    assert all(r.startswith('{"type":"match"') for r in rows[:-1]) and rows[-1].startswith('{"type":"done"')


def test_entry():
    import __spark_entry__

    assert "grep_literal" in __spark_entry__.queries() and set(SQL) <= set(__spark_entry__.oracle_sql())
