"""Every query on awkward rows and on empty tables; those with SQL against DuckDB."""

import pytest
from oracle import answers, same

from dredge.llm import registry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, odd, name):
    out = registry.queries()[name](spark, odd[0])
    n = {"op4_chat_format": 6, "op10_url_filter": 16}.get(name, 15)
    assert len(out.columns) == len(set(out.columns))
    got = out.collect()
    if name == "op8_packing":  # a row per piece: one document each at least, and the long ones more
        assert len({r["doc_id"] for r in got}) == 14 and sum(r["piece"] == 0 for r in got) == n < len(got)
    else:
        assert len(got) == n
    if name not in ("op4_chat_format", "op10_url_filter"):
        assert {r["doc_id"] for r in got} == {*range(13), None}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, odd, name):
    assert registry.queries()[name](spark, odd[1]).count() == (name == "op4_chat_format")


@pytest.fixture(scope="module")
def expected(tmp_path_factory):
    return answers(DIR, registry.oracle_sql(), tmp_path_factory.mktemp("oracle"))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, expected, name):
    assert same(registry.queries()[name](spark, DIR), expected[name])
